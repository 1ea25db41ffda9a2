"""Cell matrices (array of rows of strings): cleaning, repair, headers, records and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, clean_cell, collapse, word_count

# How a value in a table is written, and words that mark a table's title row.
VALUE = r"(?i)(?<!\S)(\(?[-–—]?(?:₦|N|\$|£|€)?\d[\d,]*(?:\.\d+)?%?\)?|[-–—]|N/?A)(?!\S)"
TITLE_WORDS = ("major ", "statement", "income", "financial position", "cash flow", "revenue", "performance", "segment", "capital", "assets", "liabilities", "equity")
TITLE_DISTANCE, TITLE_WORDS_MAX, TITLE_ROWS, HEADER_MATCH = 120, 20, 12, 0.80

_EMPTY = "cast(array() as array<string>)"


def clean_matrix(m: Column) -> Column:
    """Clean cells, without rows that are empty."""
    return F.filter(F.transform(m, lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda c: c != ""))


def width(m: Column) -> Column:
    """Cells in the widest row, 0 for no rows."""
    return F.coalesce(F.array_max(F.transform(m, F.size)), F.lit(0))


def rectangular(m: Column, w: Column | None = None) -> Column:
    """Rows padded with empty cells to the widest; ``w``, the width as a column, saves working it out for each row."""
    w = width(m) if w is None else w
    return F.transform(m, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r))))


def is_useful(m: Column) -> Column:
    """At least two rows, two columns and four cells with text."""
    return (F.size(m) >= 2) & (width(m) >= 2) & (F.size(F.filter(F.flatten(m), lambda c: c != "")) >= 4)


def repair_row(row: Column, columns: Column) -> Column:
    """A row whose text all went to its first cell, as label and values: the cell must end in exactly the missing number of values."""
    cells = F.concat(F.slice(row, F.lit(1), columns), F.array_repeat(F.lit(""), columns - F.size(row)))
    first = collapse(cells[0])
    found = F.regexp_extract_all(first, F.lit(VALUE), F.lit(1))
    n = columns - 1
    values = F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), n)
    tail = F.array_join(values, " ")
    label = F.trim(F.substring(first, F.lit(1), F.length(first) - F.length(tail)))
    alone = ~F.exists(F.slice(cells, F.lit(2), F.greatest(n, F.lit(0))), lambda c: F.trim(c) != "")
    fits = (columns > 1) & alone & (F.size(found) >= n) & first.endswith(tail) & (label != "")
    return F.when(columns <= 1, row).when(fits, F.concat(F.array(label), values)).otherwise(cells)


def repair_rows(m: Column, w: Column | None = None) -> Column:
    w = width(m) if w is None else w
    return F.transform(m, lambda r: repair_row(r, w))


def unique_headers(h: Column) -> Column:
    """Blank names become ``column_i``; the k-th use of a name gets ``_k`` from the second on."""
    named = F.transform(h, lambda c, i: F.when(F.trim(c) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(F.trim(c)))
    seen = lambda names, c, i: F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda x: x == c))
    one = lambda names, c, i: F.when(seen(names, c, i) > 1, F.concat(c, F.lit("_"), seen(names, c, i).cast("string"))).otherwise(c)
    # the array of one makes the names known by name, or all would be made again for each pair of them
    return F.transform(F.array(named), lambda names: F.transform(names, lambda c, i: one(names, c, i)))[0]


def table_headers(detected: Column, m: Column) -> Column:
    """Detected names or the first row's, brought to the table's width; a made-up first name is ``Metric``."""
    w = width(m)
    names = F.when(F.coalesce(F.exists(detected, lambda c: F.trim(c) != ""), F.lit(False)), detected).otherwise(m[0])
    names = F.concat(F.slice(names, F.lit(1), w), F.array_repeat(F.lit(""), w - F.size(names)))
    unique = unique_headers(names)
    return F.transform(unique, lambda c, i: F.when((i == 0) & c.startswith("column_"), F.lit("Metric")).otherwise(c))


def without_header_row(m: Column, headers: Column) -> Column:
    """Drops a first row that repeats the headers: at least four fifths of the cells that can be compared are equal."""
    pair = F.transform(headers, lambda h, i: F.struct(collapse(F.lower(h)).alias("h"), collapse(F.lower(F.get(m[0], i))).alias("c")))
    counted = F.filter(pair, lambda p: ~(p["h"].startswith("column_") & (p["c"] == "")))
    same = F.size(F.filter(counted, lambda p: p["h"] == p["c"]))
    repeated = (F.size(m) > 0) & (F.size(m[0]) == F.size(headers)) & (F.size(counted) > 0) & (same >= HEADER_MATCH * F.size(counted))
    return F.when(repeated, F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)


def title_from_rows(m: Column) -> Column:
    """The first of the first twelve rows that has one cell, with a word that marks titles; else null."""
    alone = F.filter(F.transform(F.slice(m, 1, TITLE_ROWS), lambda r: F.filter(r, lambda c: c != "")), lambda r: F.size(r) == 1)
    def marked(c):
        out = F.lit(False)
        for word in TITLE_WORDS:
            out = out | F.lower(c).contains(word)
        return out
    return F.get(F.filter(F.transform(alone, lambda r: r[0]), marked), F.lit(0))


def records(headers: Column, m: Column) -> Column:
    """A map of header to cell for every row with text; of equal headers the last cell stays."""
    full = F.filter(m, lambda r: F.exists(r, lambda c: c != ""))
    later = lambda i: F.slice(headers, i + 2, F.greatest(F.size(headers) - i - 1, F.lit(0)))
    places = F.filter(F.transform(headers, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda e: ~F.array_contains(later(e["i"]), e["h"]))
    one = lambda r, kept: F.map_from_entries(F.transform(kept, lambda e: F.struct(e["h"].alias("key"), F.coalesce(F.get(r, e["i"]), F.lit("")).alias("value"))))
    # the array of one makes the places known by name, or they would be found again for each row
    return F.transform(F.array(places), lambda kept: F.transform(full, lambda r: one(r, kept)))[0]


def ordered_rows(headers: Column, rows: Column) -> Column:
    """Maps back to cells in header order, missing ones empty."""
    return F.transform(rows, lambda r: F.transform(headers, lambda h: F.coalesce(F.element_at(r, h), F.lit(""))))


def retrieval_text(title: Column, headers: Column, m: Column, ticker: Column, year: Column, page: Column) -> Column:
    """The table as lines: what it belongs to, then each row's label and its named values."""
    empty = F.expr(_EMPTY)
    head = F.concat(
        F.array(F.concat(F.lit("Company: "), ticker), F.concat(F.lit("Reporting year: "), year.cast("string")), F.concat(F.lit("PDF page: "), page.cast("string"))),
        F.when(F.coalesce(title, F.lit("")) != "", F.array(F.concat(F.lit("Table: "), title))).otherwise(empty), F.array(F.lit("")),
    )

    def row(r):
        label = F.trim(r[0])
        named = F.transform(r, lambda c, i: F.struct(c.alias("c"), i.alias("i"), F.coalesce(F.get(headers, i), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("h")))
        shown = F.filter(named, lambda x: (x["c"] != "") & ~((x["i"] == 0) & (label != "")))
        first = F.when(label != "", F.concat(F.lit("Metric: "), label)).otherwise("Table row:")
        return F.concat(F.array(first), F.transform(shown, lambda x: F.concat(x["h"], F.lit(": "), x["c"])), F.array(F.lit("")))

    full = F.filter(m, lambda r: F.exists(r, lambda c: c != ""))
    text = F.array_join(F.concat(head, F.flatten(F.transform(full, row))), "\n")
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_title_candidate(text: Column, y1: Column, x0: Column, x1: Column, table_x0: Column, table_y0: Column, table_x1: Column) -> Column:
    """A short text above the table, near and overlapping it sideways."""
    over = F.greatest(F.lit(0.0), F.least(x1, table_x1) - F.greatest(x0, table_x0)) > 0
    return (text != "") & (y1 <= table_y0) & (table_y0 - y1 <= TITLE_DISTANCE) & over & (word_count(text) <= TITLE_WORDS_MAX)
