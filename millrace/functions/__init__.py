"""Column functions: text forms, predicates, table cells, scores, money."""
