import hashlib
import json
import random

import pytest

from millrace.operators import chunking, layout
from millrace.operators import report_tables as rt
from tests.test_operators import BLOCK, block

TABLE = "report_id string, ticker string, report_year int, page_number int, table_index int, tx0 double, ty0 double, tx1 double, ty1 double, detected array<string>, matrix array<array<string>>"


def table(index, m, detected=None, box=(50.0, 300.0, 400.0, 500.0), page=1, report="r"):
    return (report, "T", 2024, page, index, *box, detected, m)


@pytest.mark.parametrize("levels", [0, 1, 2, 3])
def test_values_are_carried_over_spans(spark, levels):
    rng = random.Random(levels)
    rows = [(g, n, rng.choice([None, None, None, f"{g}{n}"])) for g in ("a", "b", None) for n in sorted(rng.sample(range(200), 60))]
    got = layout.carried_before(spark.createDataFrame(rows, "g string, n int, v string"), ["g"], "n", "v", span=4, levels=levels).collect()
    for r in got:
        earlier = [v for g, n, v in rows if g == r.g and n < r.n and v is not None]
        assert r.before == (earlier[-1] if earlier else None)
    assert len(got) == len(rows) and set(got[0].asDict()) == {"g", "n", "v", "before"}


def test_repeated_margins_go_from_the_middle_too(spark):
    rows = [block(p, 0, f"Annual Report {p}", 10, 5, 200, 20) for p in range(1, 7)] + [block(3, 1, "annual  report 99", 10, 400, 200, 420), block(3, 2, "Other text here", 10, 440, 200, 460)]
    nameless = [(None, *r[1:]) for r in rows]
    left = layout.drop_margins(spark.createDataFrame(rows + nameless, BLOCK)).collect()
    assert sorted((str(r.report_id), r.text) for r in left) == [("None", "Other text here"), ("r", "Other text here")]


def test_contents_pages_go(spark):
    rows = [block(1, 0, "Contents", 10, 50, 200, 60), *(block(1, i, f"Part\n{i}", 10, 60 + i, 200, 61 + i) for i in range(1, 6)), block(2, 0, "Contents are fine here", 10, 50, 200, 60), block(3, 0, None, 10, 50, 200, 60)]
    assert {r.page_number for r in layout.drop_contents_pages(spark.createDataFrame(rows, BLOCK)).collect()} == {2, 3}


def test_columns_are_told_by_what_keeps_to_a_side(spark):
    long = "word " * 45
    # the second page's right blocks reach over the middle by more than the tolerance
    rows = [block(1, 0, "right " + long, 310, 100, 580, 400), block(1, 1, "left " + long, 20, 200, 340, 400)] + [block(2, 0, "upper " + long, 200, 100, 580, 200), block(2, 1, "lower " + long, 20, 300, 340, 400)]
    out = layout.reading_order(spark.createDataFrame(rows, BLOCK)).orderBy("page_number", "place").collect()
    assert [(r.text.split()[0], r["columns"]) for r in out] == [("left", 2), ("right", 2), ("upper", 1), ("lower", 1)]


def test_long_paragraphs_come_in_pieces_and_short_pages_not_at_all(spark):
    words = " ".join(f"alpha{i}" for i in range(400))
    sentences = " ".join("Some seven words make up this one." for _ in range(60))
    rows = [block(1, 0, words, 20, 50, 300, 70), block(2, 0, sentences, 20, 50, 300, 70), block(3, 0, "Only four words here", 20, 50, 300, 70)]
    out = layout.paragraphs(spark.createDataFrame(rows, BLOCK)).orderBy("page_number", "para", "piece").collect()
    assert [(r.page_number, r.piece, len(r.text.split())) for r in out] == [(1, 0, 180), (1, 1, 180), (1, 2, 40), (2, 0, 175), (2, 1, 175), (2, 2, 70)]


def test_sections_reach_over_empty_pages(spark):
    rows = [block(1, 0, "Risk management", 20, 50, 300, 70, 14.0, True), block(5000, 0, "Ten words of text that stand on a page much later.", 20, 50, 300, 70)]
    out = layout.paragraphs(spark.createDataFrame(rows, BLOCK)).collect()
    assert [(r.page_number, r.section_title) for r in out] == [(5000, "Risk management")]


def test_blocks_without_rows(spark):
    empty = spark.createDataFrame([], BLOCK)
    none = spark.createDataFrame([], TABLE)
    assert layout.read_report(empty, none).count() == 0 and rt.table_records(none, empty).count() == 0


def test_nearest_title(spark):
    t = [table(1, []), table(2, [], box=(50.0, 120.0, 90.0, 200.0)), table(3, [], box=(500.0, 300.0, 590.0, 400.0)), table(1, [], report=None)]
    b = [
        block(1, 9, "tie, later", 60, 200, 200, 240), block(1, 4, "tie, first", 60, 220, 200, 240), block(1, 1, "too far", 60, 100, 200, 179), block(1, 2, "beside", 401, 200, 450, 290),
        block(1, 3, "below the edge", 60, 290, 200, 301), block(1, 5, "w " * 21, 60, 280, 200, 290), block(1, 6, " ", 60, 280, 200, 295), block(1, 7, "at the edge", 60, 0, 80, 0), block(2, 0, "another page", 60, 200, 200, 299),
    ]
    b += [(None, *block(1, 0, "nameless", 60, 200, 200, 300)[1:])]
    got = {(r.report_id, r.table_index): r.title for r in rt.nearest_titles(spark.createDataFrame(t, TABLE), spark.createDataFrame(b, BLOCK)).collect()}
    assert got == {("r", 1): "tie, first", ("r", 2): "at the edge", (None, 1): "nameless"}


def test_table_records(spark):
    m1 = [["Metric", "2024", "2023"], [" ", None, ""], ["Revenue 1,234 (5.6%)", "", ""], ["Profit", "1", "–"], ["no values here", "", ""], ["only one 7", "", ""]]
    m2 = [["a", "a", ""], ["x", "y z", "w"], ["", "Statement of income", ""], ["q\"\\", "2", "3"]]
    rows = [table(1, m1), table(2, m2, ["Kind", "Kind", " "]), table(3, [["one", "two"]]), table(4, None), table(5, []), table(6, [["h", "i"], ["h", "i"], ["j", "k"]], ["H", " i "])]
    blocks = spark.createDataFrame([block(1, 0, "The\nfigures", 60, 200, 200, 240)], BLOCK)
    got = {r.table_index: r for r in rt.table_records(spark.createDataFrame(rows, TABLE), blocks).collect()}
    assert sorted(got) == [1, 2, 6]
    one = got[1]
    assert one.table_title == "The figures" and one.table_data.headers == ["Metric", "2024", "2023"] and (one.row_count, one.column_count) == (4, 3)
    assert one.table_data["rows"][0] == {"Metric": "Revenue", "2024": "1,234", "2023": "(5.6%)"}
    assert one.rag_text.startswith("Company: T\nReporting year: 2024\nPDF page: 1\nTable: The figures\n\nMetric: Revenue\n2024: 1,234\n2023: (5.6%)\n\nMetric: Profit\n2024: 1\n2023: –")
    assert one.text_sha256 == hashlib.sha256(one.rag_text.encode()).hexdigest() and one.word_count == len(one.rag_text.split()) and one.character_count == len(one.rag_text)
    two = got[2]
    assert two.table_title == "Statement of income" and two.table_data.headers == ["Kind", "Kind_2", "column_3"] and two.row_count == 4
    cells = [["a", "a", ""], ["x", "y z", "w"], ["", "Statement of income", ""], ['q"\\', "2", "3"]]
    digest = hashlib.sha256(f"r|1|2|{json.dumps(cells, ensure_ascii=False)}".encode()).hexdigest()[:16]
    assert two.table_id == f"r_p0001_table_02_{digest}"
    # a first row like the detected names goes, an equal one after it stays
    assert [list(x.values()) for x in got[6].table_data["rows"]] == [["h", "i"], ["j", "k"]]


def test_packing_holds_no_more_than_a_chunk():
    packer, most, given = chunking.Packer(("r", "t", 2024)), 0, 0
    for i in range(300_000):
        given += len(packer.add(f"some seven words in the paragraph {i}", i, None, False))
        most = max(most, len(packer.held))
    assert given + len(packer.end()) > 5000 and most <= 400 / 7 + 1


def test_chunks_across_batches_and_reports(spark):
    rng = random.Random(5)
    rows = []
    for r in [*(f"r{i}" for i in range(12)), None]:
        for para in range(rng.choice([1, 3, 40, 900])):
            section = rng.choice([None, "A", "B"]) if para % 50 == 0 else None
            rows.append((r, "t", 2024, para // 7, para, " ".join("w" for _ in range(rng.randint(1, 60))) + f" {para}.", section, rng.random() < 0.2))
    rows.append(("r0", "t", 2024, 999, 0, None, None, None))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    schema = "report_id string, ticker string, report_year int, page_number int, para int, text string, section_title string, contains_table boolean"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = sorted((tuple(r) for r in chunking.chunk(spark.createDataFrame(shuffled, schema)).collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for r in {x[0] for x in rows}:
        own = [(x[5], x[3], x[6], x[7]) for x in rows if x[0] == r and x[5] is not None]
        want += [tuple(c.values()) for c in chunking.pack((r, "t", 2024), own)]
    assert got == sorted(want, key=str) and len(got) > 50
