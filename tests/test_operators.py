from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import layout, monitor, search
from millrace.operators import validate as v
from millrace.operators.growth import flatten_snapshot, with_growth
from millrace.plans.api import Engine, Request, extractive, feedback_row, interaction_row
from millrace.sources import fixtures as fx
from millrace.sources import readers, writers
from millrace.streaming import monitor as stream

BLOCK = "report_id string, page_number int, block_index int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, max_font_size double, median_font_size double, is_bold boolean"


def block(page, i, text, x0, y0, x1, y1, font=10.0, bold=False):
    return ("r", page, i, text, float(x0), float(y0), float(x1), float(y1), 600.0, 800.0, font, 10.0, bold)


def test_table_regions_and_margins_go(spark):
    rows = [block(p, 0, f"Annual Report {p}", 10, 5, 200, 20) for p in range(1, 7)] + [block(1, 1, "Inside a table", 100, 300, 200, 320), block(1, 2, "Narrative text", 100, 500, 200, 520)]
    blocks = spark.createDataFrame(rows, BLOCK)
    tables = spark.createDataFrame([("r", 1, 90.0, 290.0, 250.0, 330.0)], "report_id string, page_number int, tx0 double, ty0 double, tx1 double, ty1 double")
    left = {r.text for r in layout.drop_margins(layout.drop_table_blocks(blocks, tables)).collect()}
    assert left == {"Narrative text"}


def test_two_columns_in_reading_order(spark):
    long = "word " * 45
    rows = [block(1, 0, "right " + long, 320, 100, 580, 400), block(1, 1, "left " + long, 20, 100, 280, 400), block(1, 2, "head over both", 20, 40, 580, 60), block(1, 3, "foot over both", 20, 500, 580, 520)]
    out = layout.reading_order(spark.createDataFrame(rows, BLOCK)).orderBy("place").collect()
    assert [r.text.split()[0] for r in out] == ["head", "left", "right", "foot"]


def test_paragraphs_and_sections(spark):
    rows = [
        block(1, 0, "Risk management", 20, 50, 300, 70, 14.0, True), block(1, 1, "The bank takes many risks and", 20, 80, 300, 95),
        block(1, 2, "watches all of them every day.", 20, 96, 300, 110), block(1, 3, "Losses were small in this year.", 20, 112, 300, 130), block(1, 4, "7", 20, 700, 30, 710),
        block(2, 0, "More words about the same section follow here on this page.", 20, 50, 300, 70),
    ]
    out = layout.paragraphs(spark.createDataFrame(rows, BLOCK)).orderBy("page_number", "para").collect()
    assert [r.text for r in out] == ["The bank takes many risks and watches all of them every day.", "Losses were small in this year.", "More words about the same section follow here on this page."]
    assert {r.section_title for r in out} == {"Risk management"}


def test_report_year(spark):
    year = lambda t: spark.range(1).select(v.report_year(F.lit(t)).alias("y")).first().y
    assert year("Annual Report and Accounts 2024") == 2024 and year("for the year ended December\n2023") == 2023
    assert year("2025 2025 2024 2025") == 2025 and year("2025 2025") is None
    with pytest.raises(v.ValidationError):
        v.require_rows(spark.range(0), "reports")


def test_merge_keeps_the_latest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e"), (3, 2, "f")], "k int, v int, x string")
    assert {(r.k, r.x) for r in monitor.merge_by_key(old, new, ["k"], "v").collect()} == {(1, "c"), (2, "b"), (3, "f")}


def test_upsert_and_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a")], "k int, v int, x string")
    for k, x in ((1, "b"), (2, "c")):
        writers.upsert(rows if k == 1 else spark.createDataFrame([(1, 2, x), (k, 1, x)], rows.schema), str(tmp_path / "t"), ["k"], "v")
    assert {(r.k, r.x) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "c"), (2, "c")}
    (tmp_path / "e.jsonl").write_text('{"id": "1", "question": "q", "gold_source_ids": ["a"]}\n\n{"id": "2"}\n')
    assert readers.examples(spark, str(tmp_path / "e.jsonl")).count() == 2


def test_report_files(spark, tmp_path):
    folder = tmp_path / "ABCD" / "2024"
    folder.mkdir(parents=True)
    (folder / "Annual Report.pdf").write_bytes(b"\n%PDF-1.7 x")
    (folder / "bad.pdf").write_bytes(b"<html>")
    out = {r.filename: r for r in readers.report_files(spark, str(tmp_path)).collect()}
    assert out["Annual Report.pdf"].report_id == "abcd_2024_annual_report" and out["Annual Report.pdf"].valid and not out["bad.pdf"].valid


def test_snapshot_growth(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"as_of_year": 2025, "previous_year": 2024, "companies": {"M": {"name": "M", "metrics": [{"label": "Revenue", "current": 5197.2, "previous": 3358.5, "unit": "ngn_billion"}, {"label": "x", "current": 1, "previous": 0, "unit": "percent"}]}}}')
    out = {r.label: r for r in with_growth(flatten_snapshot(readers.snapshot(spark, str(tmp_path / "s.json")))).collect()}
    assert out["Revenue"].display_value == "₦5.20tn" and out["x"].growth_display == "N/A"


def test_api(spark, sf_dir):
    docs = fx.with_embeddings(fx.retrieval_documents(spark, sf_dir), spark, sf_dir).cache()
    engine = Engine(docs, lambda q: [1.0] * 64)
    assert engine.health() == {"status": "healthy"} and engine.stats()["documents"] == docs.count() and engine.filters()["years"] == [2023, 2024, 2025]
    answer = engine.query(Request("that was", top_k=3))
    assert len(answer.results) == 3 and answer.context.startswith("[SOURCE 1]\nType: ") and answer.answer
    agent = lambda q, context, tools: {"final_answer": str(tools["calculate"]("2 + 3")["result"]), "tools_used": [{"tool": "calculate"}]}
    assert engine.query(Request("that was", pipeline="agent"), agent=agent).answer == "5.0"
    assert engine.query(Request("qqqq", retrieval_mode="keyword")).answer.startswith("No relevant")
    # keyword search stems and leaves out stop words unless asked otherwise
    assert engine.search_keyword("ering", top_k=2)["count"] == 2 and engine.search_keyword("that", top_k=2)["count"] == 0
    assert engine.get_table("x") == {"success": True, "found": False, "table": None}
    assert extractive("q", "") .startswith("No relevant")
    row = interaction_row(spark, Request("q", ticker="T"), None, "boom").first()
    assert row.status == "failed" and row.ticker is None and row.judge_status == "not_run"
    for bad in (lambda: Request(""), lambda: Request("q", top_k=51), lambda: Request("q", retrieval_mode="x"), lambda: feedback_row(spark, "r", 2), lambda: search.retrieve(docs, "q", mode="x")):
        with pytest.raises(ValueError):
            bad()
    docs.unpersist()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    i = fx.interactions(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    i.write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(i.schema).parquet(str(tmp_path / "log"))
    q = stream.responses_over_time(source).writeStream.format("memory").queryName("panel").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.time.replace(tzinfo=None), r.responses) for r in spark.table("panel").collect()}
    batch = monitor.responses_over_time(fx.interactions(spark, sf_dir), datetime(2000, 1, 1), datetime(2100, 1, 1))
    assert got == {(r.time, r.responses) for r in batch.collect()}


def test_upsert_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 1, "c")], "k int, v int, x string").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("k int, v int, x string").parquet(str(tmp_path / "in"))
    for n in range(2):
        if n:
            spark.createDataFrame([(2, 2, "d"), (1, 2, "z")], "k int, v int, x string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.upsert_stream(events, str(tmp_path / "table"), ["k"], "v", str(tmp_path / "cp")).awaitTermination()
    assert {(r.k, r.x) for r in stream.latest_table(spark, str(tmp_path / "table")).collect()} == {(1, "b"), (2, "d")}
