"""Ids with several texts."""

from millrace.llm import minhash


def test_unequal_texts_of_one_id_are_all_linked(spark):
    a, b = ([f"{x}{k}" for k in range(40)] for x in "ab")
    rows = [(6, " ".join(a)), (6, " ".join(b)), (7, " ".join([*a[:-1], "end"])), (8, " ".join([*b[:-1], "end"])), (9, "alone here")]
    got = sorted((r.id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect())
    assert got == [(6, 6, True), (6, 6, True), (7, 6, False), (8, 6, False), (9, 9, True)]
