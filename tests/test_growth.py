"""Work that grew faster than the rows: small tables with the bad shape, held against their SQL or plain Python."""

import hashlib
import random
import time

import duckdb
from pyspark.sql import functions as F

from millrace.operators import evaluate, layout
from millrace.plans import evaluation, ingestion
from millrace.sources import fixtures
from tests import oracle


def test_table_records_of_long_tables(spark, sf_dir, tmp_path):
    """Three tables of 700 rows; with the matrix made again for every row this took minutes."""
    rows = [(i, f"Supplier {i}", i % 3) for i in range(2100)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.monotonic()
    got = ingestion.table_records(spark, str(tmp_path)).toPandas()
    assert time.monotonic() - began < 60
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert oracle.rows(got) == oracle.rows(con.sql(ingestion.TABLE_SQL).df())


def test_later_partners_over_blocks(spark, monkeypatch):
    """Blocks of a few documents, ids that repeat, rows without a company or a type; every pair held against every other."""
    monkeypatch.setattr(evaluate, "BLOCK", 7)
    rng = random.Random(5)
    docs = [(f"d{rng.randrange(150):03}", rng.choice(["a", "a", "b", None]), rng.choice([2023, 2024]), "r", rng.choice(["n", "t", None]), rng.choice(["", "One", "Two", None]), " ".join(rng.sample(["cash", "risk", "loan", "x"], 2))) for _ in range(160)]
    df = spark.createDataFrame(docs, "document_id string, ticker string, report_year int, report_id string, content_type string, section_title string, text string")
    best = {}
    for a in docs:
        for b in docs:
            if a[0] < b[0] and a[1] is not None and a[1:3] == b[1:3] and a[4] and b[4]:
                score = (a[4] == b[4]) + 3 * bool(a[5] and a[5] == b[5]) + sum(t in a[6] and t in b[6] for t in ("cash", "risk", "loan"))
                if score:
                    best.setdefault(a[0], []).append((-score, b[0]))
    want = sorted((a, b, -s) for a, x in best.items() for s, b in sorted(x)[:4])
    got = evaluate.same_report_pairs(df, ["cash", "risk", "loan"]).collect()
    assert sorted((r.left_id, r.right_id, r.score) for r in got) == want


def test_digests_beyond_a_bound_are_not_sorted(spark, monkeypatch, tmp_path):
    """The same ranks whether a half of the vectors bounds the last one, or so few that nothing does."""
    spark.createDataFrame([(i, i % 7 if i % 11 else None) for i in range(900)], "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = []
    for part in (2, 900):
        monkeypatch.setattr(evaluation, "PART", part)
        got.append(sorted(map(tuple, evaluation._ranked(spark, str(tmp_path)).collect())))
    want = []
    for q in range(0, 900, 50):
        for n, i in enumerate(sorted(range(900), key=lambda i: hashlib.sha256(f"{q}|{i}".encode()).hexdigest())[:20], 1):
            want.append((q, n, bool(q % 11 and i % 11 and q % 7 == i % 7), sum(k % 7 == q % 7 for k in range(900) if k % 11) if q % 11 else 0))
    assert got == [sorted(want)] * 2


def test_margins_make_no_row_a_line(spark, tmp_path):
    texts = [("Annual report 1\n" + "x y\n" * 500 + "Page 1 end", 0), ("Annual report 2\nx\nPage 2 end", 1), ("one line", 2), (None, 3), ("\n", 4)]
    spark.createDataFrame([(i, t, "s") for t, i in texts], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ingestion.margin_frequency(spark, str(tmp_path))
    assert {(r.form, r.pages) for r in got.collect()} == {("annual report <number>", 2), ("page <number> end", 2)}
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_made_where_the_documents_lie(spark):
    """Runs of a few tokens give what plain Python gives, and no token is shuffled."""
    from millrace.functions.analysis import analyze
    from millrace.operators import index

    texts = ["The cats were sleeping, the cat slept", "", None, "of the", "Running runs 12 x", "cats of cats"]
    docs = spark.createDataFrame([(f"d{i}", None if i == 4 else "t", 2024, x) for i, x in enumerate(texts)], "document_id string, ticker string, report_year int, text string").coalesce(1)
    for analyzer in ("simple", "english"):
        found = index.postings(docs, analyzer)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        want = {}
        for i, x in enumerate(texts):
            dense = 0
            for pos, w in enumerate(analyze(x or "", analyzer)):
                if w is not None:
                    want.setdefault((w, f"d{i}", None if i == 4 else "t", 2024), []).append((pos, dense))
                    dense += 1
        got = {(r.term, r.document_id, r.ticker, r.report_year): (r.n, [tuple(p) for p in r.places]) for r in found.collect()}
        assert got == {k: (len(v), v) for k, v in want.items()}


def test_pages_are_made_once(spark, tmp_path):
    """The section in force reads written pages, not the layout chain twice; regions of tables make no cells."""
    rows = [("r", p, p % 3 == 0, f"h{p}", 1) for p in range(1, 3000)]
    headed = spark.createDataFrame(rows, "report_id string, page_number long, heading boolean, flat string, place int").withColumn("flat", F.concat("flat", F.lit("!")))
    got = layout.page_sections(headed)
    assert "concat" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.page_number: r.section_title for r in got.collect()} == {p: f"h{p - p % 3}!" if p > 2 else None for p in range(1, 3000)}
    spark.createDataFrame([(5, "a, b\nc", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    tables = fixtures.page_tables(spark, str(tmp_path))
    assert "lambda" not in tables.select("page_number", "tx0", "ty0", "tx1", "ty1")._jdf.queryExecution().optimizedPlan().toString()
    assert [r.table_index for r in tables.collect()] == [1, 2]


def test_margins_longer_or_shorter_than_their_form(spark):
    """A header whose digits make it longer than its form, and one of two lines, go wherever they stand; a long line without digits stays."""
    texts = ["Year " + "7" * 40, "Two\nlines here", "A line longer than any form of a margin", None]
    rows = [("r", p, i, t, 0.0, 0.0 if i < 2 else 50.0, 10.0, 1.0 if i < 2 else 60.0, 100.0, 100.0) for p in range(8) for i, t in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "report_id string, page_number long, block_index int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert {(r.page_number, r.block_index) for r in layout.drop_margins(blocks).collect()} == {(p, i) for p in range(8) for i in (2, 3)}
