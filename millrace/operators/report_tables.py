"""Table records: cell matrices of a page's tables with headers, nearest title, text and id.

Tables come with report_id, ticker, report_year, page_number, table_index, their box
(tx0, ty0, tx1, ty1), the detected header names (may be null) and the matrix of
cells; blocks as in ``layout``. Null matrices give no record; pages are joined nulls
included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as tb
from ..functions.text import clean_cell, step, word_count
from .layout import PAGE, _join

KEY = [*PAGE, "table_index"]


def nearest_titles(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """(report_id, page_number, table_index, title): for each table the nearest short text above it that overlaps it sideways.

    Blocks and tables meet by page and by bands as high as the farthest title: a
    table asks in the band of its upper edge and in the one above. Ties go to the
    smaller block_index; only the least distance is kept on the way, so a page with many
    blocks costs one row a table.
    """
    band = lambda y: F.floor(y / tb.TITLE_DISTANCE).cast("int")
    asks = tables.select(*KEY, "tx0", "ty0", "tx1", F.explode(F.array(band(F.col("ty0")), band(F.col("ty0")) - 1)).alias("band"))
    texts = step(blocks.select(*PAGE, "block_index", "text", "x0", "x1", "y1", band(F.col("y1")).alias("band")), "title", clean_cell(F.col("text"))).drop("text")
    met = _join(asks, texts, [*PAGE, "band"], "inner")
    fit = met.where(tb.is_title_candidate(F.col("title"), F.col("y1"), F.col("x0"), F.col("x1"), F.col("tx0"), F.col("ty0"), F.col("tx1")))
    return fit.groupBy(*KEY).agg(F.min_by("title", F.struct(F.col("ty0") - F.col("y1"), "block_index")).alias("title"))


def _quoted(cell: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(cell, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def table_id(report: Column, page: Column, index: Column, m: Column) -> Column:
    """Report, page and index with the start of a digest over them and the cells."""
    cells = F.concat(F.lit("["), F.array_join(F.transform(m, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, _quoted), ", "), F.lit("]"))), ", "), F.lit("]"))
    digest = F.sha2(F.concat_ws("|", report, page.cast("string"), index.cast("string"), cells), 256)
    return F.concat(report, F.format_string("_p%04d_table_%02d_", page.cast("long"), index.cast("long")), F.substring(digest, 1, 16))


def table_records(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """One record a useful table.

    Cells are cleaned and collapsed rows repaired; headers are the detected names or
    the first row; a first row that repeats them goes; the title is one among the
    rows, else the nearest text above. ``table_data`` holds headers and rows by header.
    """
    m = F.col("m")
    t = step(tables.where("matrix is not null"), "m", tb.clean_matrix(F.col("matrix"))).where(F.size("m") > 0)
    w = F.col("column_count")
    t = step(step(t, "column_count", tb.width(m)), "m", tb.rectangular(m, w))
    t = step(step(t, "m", tb.repair_rows(m, w)).where(tb.is_useful(m)), "detected", F.transform("detected", clean_cell))
    t = step(t, "headers", tb.table_headers(F.col("detected"), m))
    t = step(t, "m", tb.without_header_row(m, F.col("headers"))).where(F.size("m") > 0)
    titles = nearest_titles(tables, blocks)
    t = step(_join(t, titles, KEY, "left"), "table_title", F.coalesce(tb.title_from_rows(m), "title"))
    text = tb.retrieval_text(F.col("table_title"), F.col("headers"), m, F.col("ticker"), F.col("report_year"), F.col("page_number"))
    t = step(t, "rag_text", text)
    return t.select(
        table_id(F.col("report_id"), F.col("page_number"), F.col("table_index"), m).alias("table_id"), "report_id", "ticker", "report_year", F.col("page_number").alias("pdf_page_number"),
        "table_index", "table_title", F.size("m").alias("row_count"), "column_count", F.struct("headers", tb.records(F.col("headers"), m).alias("rows")).alias("table_data"), "rag_text",
        F.length("rag_text").alias("character_count"), word_count(F.col("rag_text")).alias("word_count"), F.sha2("rag_text", 256).alias("text_sha256"),
    )
