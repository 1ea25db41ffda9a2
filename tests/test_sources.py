"""Readers, writers, schemas and the log's row forms on small data."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, layout, monitor, validate
from millrace.sources import readers, schemas, writers


def test_manifest_and_missing_reports(spark, tmp_path):
    rows = [("A Plc", "AAA", 2024, "a.pdf", "https://x/a", True), ("A Plc", "AAA", 2025, "b.pdf", "https://x/b", True)]
    wanted = readers.manifest(spark, rows)
    with pytest.raises(ValueError):
        readers.manifest(spark, [rows[0], rows[0]])
    folder = tmp_path / "AAA" / "2024"
    folder.mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"  %PDF-1.7")
    files = readers.report_files(spark, str(tmp_path))
    assert [r.filename for r in readers.missing_reports(wanted, files).collect()] == ["b.pdf"]
    assert readers.ordered_reports(files).first().report_id == "aaa_2024_a"
    with pytest.raises(validate.ValidationError):
        readers.report_files(spark, str(tmp_path), pattern="*.docx")
    with pytest.raises(validate.ValidationError):
        readers.ordered_reports(files.where("false"))
    with pytest.raises(ValueError):
        readers.ordered_reports(files.withColumn("file_path", F.lit("")))


def test_blocks_and_matrices_from_files(spark, tmp_path):
    box = {"x0": 0, "y0": 100, "x1": 90, "y1": 120, "page_width": 100, "page_height": 800, "max_font_size": 9, "median_font_size": 9, "is_bold": False}
    lines = [{"report_id": "r", "page_number": 1, "block_index": i, "text": t, **box, "y0": y, "y1": y + 10} for i, (t, y) in enumerate([("body text", 300), ("in table", 500)])]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "t.json").write_text(json.dumps({"report_id": "r", "page_number": 1, "table_index": 0, "tx0": 0, "ty0": 490, "tx1": 100, "ty1": 600, "matrix": [["a", "1"]]}))
    blocks, tables = readers.blocks(spark, str(tmp_path / "b.json")), readers.matrices(spark, str(tmp_path / "t.json"))
    assert [r.text for r in layout.report_blocks(blocks, tables).collect()] == ["body text"]
    assert tables.first().matrix == [["a", "1"]]


def test_json_lines_snapshot_flashcards_and_series(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id":"1","question":"q","gold_source_ids":["a"]}\n\n{"id":"2","question":"p"}\n')
    assert sorted(r.id for r in readers.examples(spark, str(tmp_path / "e.jsonl")).collect()) == ["1", "2"]
    (tmp_path / "f.json").write_text('[{"front":"x","back":"y"},{"front":"z","back":"w"}]')
    assert readers.flashcards(spark, str(tmp_path / "f.json")).count() == 2
    hours = readers.hour_series(spark, datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 3, 10)).collect()
    assert [r.time.hour for r in hours] == [0, 1, 2, 3] and readers.healthy(spark)
    asked = readers.synthetic_questions(spark, 50, ["a", "b", "c"])
    assert {r.question for r in asked.collect()} == {"a", "b", "c"} and asked.collect() == readers.synthetic_questions(spark, 50, ["a", "b", "c"]).collect()
    pages = readers.page_texts(spark.createDataFrame([("r", 1, " x"), ("r", 2, " "), ("r", 3, None)], "report_id string, page_number int, text string"))
    assert [(r.character_count, r.has_text) for r in pages.orderBy("page_number").collect()] == [(2, True), (1, False), (0, False)]


def test_writers_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, at int")
    writers.replace(df, str(tmp_path / "s/t"), ["k"])
    writers.append(df.select("v", "at", "k"), str(tmp_path / "s/t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "s/t")).count() == 4
    writers.replace(df, str(tmp_path / "s/t"))
    assert writers.copy_tables(spark, str(tmp_path / "s"), str(tmp_path / "c"), ["t"]) == {"t": 2}
    writers.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    parts = spark.createDataFrame([(2, "Findings", "f"), (1, "Summary", "s")], "position int, section string, text string")
    writers.markdown_report(parts, str(tmp_path / "m"), "Title")
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "m"), wholetext=True).collect()).strip() == "# Title\n\n## Summary\n\ns\n\n## Findings\n\nf"
    writers.debug_dump(df, str(tmp_path / "d"), F.col("k"))
    assert not (tmp_path / "d").exists()
    writers.debug_dump(df.withColumn("report_id", F.col("k")), str(tmp_path / "d"), F.concat("k", F.lit("!")), enabled=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect()) == ["a!", "b!"]
    assert df.select(writers.chart_is_valid(F.array("k"), F.array("v")).alias("ok")).first().ok
    results = spark.createDataFrame([("1", "c", None, 0.5), ("2", "c", "boom", None)], "id string, category string, error string, mrr double")
    writers.evaluation_report(results, results.groupBy().count(), str(tmp_path / "r"))
    assert [spark.read.parquet(str(tmp_path / "r" / n)).count() for n in ("summary", "details", "errors")] == [1, 1, 1]


@pytest.mark.parametrize("name", ["../x", "a/b", "", "..", "a\\b"])
def test_generated_files_stay_in_their_folder(name):
    assert writers.generated_file("/out/", "deck.pptx") == "/out/deck.pptx"
    with pytest.raises(ValueError):
        writers.generated_file("/out", name)


def test_log_tables(spark, tmp_path):
    log = schemas.create_log(spark, str(tmp_path))
    assert {n: df.count() for n, df in log.items()} == dict.fromkeys(schemas.TABLES, 0) and spark.table("feedback").count() == 0
    rated = spark.createDataFrame([("a", 1), ("a", -1), ("b", 3), (None, None)], "response_id string, rating short")
    assert schemas.broken("feedback", rated) == {"check": 1, "key_null": 1, "key_repeats": 1}


def test_rows_of_requests_and_judges(spark):
    at = datetime(2024, 1, 1)
    requests = spark.createDataFrame([("r1", at, [("answer", "m", 3), ("tool", "m", 1)]), ("r2", at, [])], "response_id string, created_at timestamp, llm_calls array<struct<purpose:string,model:string,input_tokens:long>>")
    done, calls = monitor.split_interactions(requests)
    assert {(r.response_id, r.status, r.judge_status) for r in done.collect()} == {("r1", "completed", "pending"), ("r2", "completed", "pending")}
    judged = spark.createDataFrame([("r1", "j", 9, at), ("r2", "j", 8, at)], "response_id string, model string, input_tokens long, created_at timestamp")
    more = monitor.judge_calls(judged, calls)
    assert {(r.response_id, r.call_index, r.purpose) for r in calls.unionByName(more).collect()} == {("r1", 0, "answer"), ("r1", 1, "tool"), ("r1", 2, "judge"), ("r2", 0, "judge")}
    failed = monitor.failed_interactions(spark.createDataFrame([("r3", "AAA", 2024, "boom")], "response_id string, ticker string, report_year int, error_message string")).first()
    assert (failed.status, failed.judge_status, failed.ticker, failed.report_year) == ("failed", "not_run", None, None)


def test_checks_of_an_index_and_of_scores(spark):
    docs = spark.createDataFrame([("a", "table", [1.0]), ("b", "narrative", None)], "document_id string, content_type string, embedding array<double>")
    assert validate.check_index(docs.where("embedding is not null"))["tables"] == 1
    for bad in (docs, docs.where("false")):
        with pytest.raises(validate.ValidationError):
            validate.check_index(bad)
    one = '{"score":0.5,"reason":"r"}'
    df = spark.createDataFrame([(f'{{"correctness":{one},"faithfulness":{one},"relevance":{one}}}',), ('{"correctness":{"score":2,"reason":"r"}}',), ("no json",), (None,)], "p string")
    assert [r.v.valid for r in df.select(validate.valid_scores(F.col("p")).alias("v")).collect()] == [True, False, False, False]
    years = spark.createDataFrame([(2024, 2024), (2023, 2024), (None, 2024)], "found int, expected int")
    assert [r.s for r in years.select(validate.year_status(F.col("found"), F.col("expected")).alias("s")).collect()] == ["ok", "mismatch", "unknown"]


def test_chunks_with_tables(spark):
    rows = [("r1", "T", 2024, 1, i, "word " * 150, None, i == 0) for i in range(4)]
    chunks = chunking.chunk(spark.createDataFrame(rows, "report_id string, ticker string, report_year int, page_number int, para int, text string, section_title string, contains_table boolean"))
    got = chunking.with_tables(chunks).first()
    assert got.report_id == "r1" and got.chunks == chunks.count() and got.with_tables == chunks.where("contains_table").count()
