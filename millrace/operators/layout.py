"""Pages from layout blocks: table regions and margins out, reading order, paragraphs, sections.

Input blocks: report_id, page_number, block_index, text, x0, y0, x1, y1,
page_width, page_height, max_font_size, median_font_size, is_bold. Each step is a
function of its own; ``read_report`` puts them together. Windows are partitioned by
page, and joins on the page keep that partitioning, so blocks are shuffled once;
paragraphs are written once and read for the sections and for themselves. What goes
from page to page, the section in force, is carried in spans of pages and spans of
spans (``carried_before``), so a report of any length is no task's own.

Blocks of a null report or page are pages of their own, which no table region and no
section meets; blocks without text are decoration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import overlap_share, same_column
from ..functions.text import decorative_line, flatten, heading_line, line_words, margin_form, noise_line, pack_sentences, starts_list_item, step
from ..shared import kept

# Fixed values.
TOP, BOTTOM, MIN_PAGES, PAGE_SHARE = 0.08, 0.08, 5, 0.25
TABLE_OVERLAP, FULL_WIDTH, COLUMN_WORDS, COLUMN_GAP, GAP = 0.50, 0.70, 40, 0.08, 0.012
PARAGRAPH_WORDS, PIECE_WORDS, PAGE_WORDS = 180, 2, 10

PAGE = ["report_id", "page_number"]
#: Pages of a span, within which a value is carried by one window.
SPAN = 1024
#: Bytes of margin forms up to which they are broadcast; beyond, blocks and forms are shuffled by report and form.
BROADCAST_BYTES = 16 << 20


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its key columns renamed, and the condition that the keys are equal, nulls included."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in columns})
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return renamed, condition


def _join(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    renamed, condition = _same(left, right, columns)
    return left.join(renamed, condition, how).drop(*(f"__{c}" for c in columns))


def drop_table_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks less those that a table (report_id, page_number, tx0, ty0, tx1, ty1) covers by half or more; the tables of a page come as one array."""
    edges = ("x0", "y0", "x1", "y1")
    regions = tables.groupBy(*PAGE).agg(F.collect_list(F.struct(*(f"t{c}" for c in edges))).alias("__tables"))
    covered = F.exists("__tables", lambda t: overlap_share(*(F.col(c) for c in edges), *(t[f"t{c}"] for c in edges)) >= TABLE_OVERLAP)
    return blocks.join(regions, PAGE, "left").where(~F.coalesce(covered, F.lit(False))).select(*blocks.columns)


def repeated_margins(candidates: DataFrame, min_pages: int = MIN_PAGES, share: float = PAGE_SHARE) -> DataFrame:
    """(report_id, form, pages): margin forms on many pages; ``candidates`` has report_id, page_number, text of margin blocks."""
    # written, so that the forms are worked out once for both counts
    forms = step(candidates.select("report_id", "page_number", "text"), "form", margin_form(F.col("text"))).where("form <> ''").select("report_id", "page_number", "form").distinct()
    forms = kept(forms, "forms")
    total = forms.groupBy("report_id").agg(F.countDistinct("page_number").alias("total"))
    seen = forms.groupBy("report_id", "form").agg(F.count(F.lit(1)).alias("pages"))
    return _join(seen, total, ["report_id"], "inner").where(F.col("pages") >= F.greatest(F.lit(min_pages), F.ceil(share * F.col("total")))).select("report_id", "form", "pages")


def margin_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("y0") <= TOP * F.col("page_height")) | (F.col("y1") >= (1 - BOTTOM) * F.col("page_height")))


def _with_flat(blocks: DataFrame) -> DataFrame:
    """Adds ``flat``, worked out once for all steps."""
    return blocks if "flat" in blocks.columns else step(blocks, "flat", flatten(F.coalesce("text", F.lit(""))))


def drop_margins(blocks: DataFrame) -> DataFrame:
    """Blocks, with ``flat`` (the text on one line), less all whose text is that of a running header or footer of the report, wherever it stands."""
    marks = kept(repeated_margins(margin_blocks(blocks)).select("report_id", F.col("form").alias("__form")), "margins")
    m, report = _same(blocks, marks, ["report_id"])
    blocks = _with_flat(blocks)
    if (marks.agg(F.sum(F.octet_length("__form") + 64).alias("b")).first().b or 0) <= BROADCAST_BYTES:
        m = F.broadcast(m)  # the blocks stay where they are
    return blocks.join(m, report & (margin_form(F.col("text"), F.col("flat")) == F.col("__form")), "left_anti")


def report_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """What is left of a report's blocks to read: no table regions, no running margins."""
    return drop_margins(drop_table_blocks(blocks, tables))


def drop_contents_pages(blocks: DataFrame) -> DataFrame:
    """Blocks of pages that are no table of contents (``text.is_contents_page`` of the blocks' texts, one below the other), by sums over the page."""
    page = Window.partitionBy(*PAGE)
    low = F.lower(F.coalesce("text", F.lit("")))
    first = F.col("block_index") == F.min("block_index").over(page)
    marked = low.contains("contents") | low.contains("in this report") | low.contains("\nindex") | (low.startswith("index") & ~first)
    # nearly every block is one line, which needs no split
    number = lambda x: (F.octet_length(F.trim(x)) <= 3) & F.trim(x).rlike(r"^\d{1,3}$")
    text = F.coalesce("text", F.lit(""))
    numbers = F.when(text.contains("\n"), F.size(F.filter(F.split(text, "\n", -1), number))).otherwise(number(text).cast("int"))
    sums = blocks.withColumns({"__marked": marked, "__numbers": numbers}).withColumns({"__any": F.max("__marked").over(page), "__all": F.sum("__numbers").over(page)})
    return sums.where(~(F.col("__any") & (F.col("__all") >= 5))).select(*blocks.columns)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks that are no decoration, with ``flat`` (the text on one line), ``place`` from 1 on each page and ``columns``.

    Two columns are read where blocks that keep to the left, and such that keep to
    the right, have forty words each: what spans the page above the columns, the
    left, the right, what spans it further down. One column goes by (y, x), rounded.
    """
    page = Window.partitionBy(*PAGE)
    width = F.col("page_width")
    usable = _with_flat(blocks).where(~decorative_line(F.col("flat"))).withColumns({
        "__n": 1 + F.length("flat") - F.length(F.translate("flat", " ", "")), "__wide": F.col("x1") - F.col("x0") >= FULL_WIDTH * width, "__left": (F.col("x0") + F.col("x1")) / 2 < width / 2,
    })
    words = lambda side: F.sum(F.when(side, F.col("__n")).otherwise(0)).over(page)
    two = (words(F.col("x1") <= width / 2 + COLUMN_GAP * width) >= COLUMN_WORDS) & (words(F.col("x0") >= width / 2 - COLUMN_GAP * width) >= COLUMN_WORDS)
    top = F.min(F.when(~F.col("__wide"), F.col("y0"))).over(page)
    marked = usable.withColumns({"columns": F.when(two, 2).otherwise(1), "__top": top})
    region = F.when(F.col("columns") == 1, 0).when(F.col("__wide") & (F.col("y0") <= F.coalesce("__top", F.col("y0"))), 1).when(F.col("__wide"), 4).when(F.col("__left"), 2).otherwise(3)
    near = lambda c: F.when(F.col("columns") == 1, F.round(c, 1)).otherwise(F.col(c))
    order = Window.partitionBy(*PAGE).orderBy("__region", near("y0"), near("x0"), "block_index")
    return marked.withColumn("__region", region).withColumn("place", F.row_number().over(order)).drop("__n", "__wide", "__left", "__top", "__region")


def with_headings(ordered: DataFrame) -> DataFrame:
    """Adds ``body_font`` (median of the page's positive block fonts, else 0) and ``heading``."""
    fonts = F.median(F.when(F.col("median_font_size") > 0, F.col("median_font_size"))).over(Window.partitionBy(*PAGE))
    out = ordered.withColumn("body_font", F.coalesce(fonts, F.lit(0.0)))
    return step(out, "heading", F.coalesce(heading_line(F.col("flat"), F.col("is_bold"), F.col("max_font_size"), F.col("body_font")), F.lit(False)))


def carried_before(rows: DataFrame, group: list[str], order: str, value: str, span: int = SPAN, levels: int = 2) -> DataFrame:
    """Adds ``before``: the last non-null ``value`` at a smaller ``order`` (a whole number, one row each) of the group.

    A window runs within ``span`` consecutive numbers; the last values of the spans
    are carried in the same way, and so on for ``levels``. The window at the top sees
    one row for ``span ** levels`` numbers.
    """
    last = lambda *keys: F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    if not levels:
        return rows.withColumn("before", last(*group))
    cut = f"__span{levels}"
    local = rows.withColumn(cut, F.floor(F.col(order) / span)).withColumn("__local", last(*group, cut))
    ends = local.groupBy(*group, cut).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
    earlier = carried_before(ends, group, cut, "__end", span, levels - 1).select(*group, cut, F.col("before").alias("__earlier"))
    return _join(local, earlier, [*group, cut], "left").withColumn("before", F.coalesce("__local", "__earlier")).drop(cut, "__local", "__earlier")


def page_sections(headings: DataFrame) -> DataFrame:
    """(report_id, page_number, section_title): the last heading up to each page's end, carried from page to page; ``headings`` has a row or more a page with flat, heading and place."""
    pages = headings.groupBy(*PAGE).agg(F.max_by(F.when(F.col("heading"), F.col("flat")), F.when(F.col("heading"), F.col("place"))).alias("__h"))
    # written, as pages are read for their spans and for themselves
    return carried_before(kept(pages, "pages"), ["report_id"], "page_number", "__h").select(*PAGE, F.coalesce("__h", "before").alias("section_title"))


def paragraph_starts(headed: DataFrame) -> DataFrame:
    """Adds ``para``, the paragraph's number on its page; headings count as one.

    A block begins a paragraph after a heading, a change of column, a gap, the
    end of a sentence, or with a list mark.
    """
    by_page = Window.partitionBy(*PAGE).orderBy("place")
    lag = lambda c: F.lag(c).over(by_page)
    breaks = (
        lag("flat").isNull() | lag("heading") | F.col("heading") | ~same_column(lag("x0"), lag("x1"), F.col("x0"), F.col("x1"))
        | (F.col("y0") - lag("y1") > GAP * F.col("page_height")) | starts_list_item(F.col("flat")) | lag("flat").rlike("[.?!:]$")
    )
    return headed.withColumn("__break", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("para", F.sum("__break").over(by_page)).drop("__break")


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(report_id, page_number, para, piece, text, section_title): paragraphs in pieces of at most 180 words.

    A piece has two words or more and is no noise, a page ten words or more. All
    pieces of a page carry the section that holds at the page's end.
    """
    headed = paragraph_starts(with_headings(reading_order(drop_contents_pages(blocks))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "flat"))), lambda x: x["flat"])
    # a heading is a paragraph of its own; these rows tell the sections as well
    joined = kept(headed.groupBy(*PAGE, F.col("para").alias("place"), "heading").agg(F.array_join(lines, " ").alias("flat")), "paragraphs")
    sections = page_sections(joined.select(*PAGE, "place", "heading", F.when(F.col("heading"), F.col("flat")).alias("flat")))
    whole = joined.where(~F.col("heading")).where(~noise_line(F.col("flat")))
    # most paragraphs are short, which blanks tell at little cost
    cut = F.when(F.size(line_words(F.col("flat"))) <= PARAGRAPH_WORDS, F.array("flat")).otherwise(pack_sentences(F.col("flat"), PARAGRAPH_WORDS))
    pieces = whole.select(*PAGE, F.col("place").alias("para"), F.posexplode(cut).alias("piece", "text"))
    useful = pieces.withColumn("__n", F.size(line_words(F.col("text")))).where((F.col("__n") >= PIECE_WORDS) & ~noise_line(F.col("text")))
    useful = useful.withColumn("__w", F.sum("__n").over(Window.partitionBy(*PAGE))).where(F.col("__w") >= PAGE_WORDS).drop("__n", "__w")
    return useful.join(sections, PAGE, "left")


def read_report(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Paragraphs (see ``paragraphs``) of whole reports from their blocks and table regions."""
    return paragraphs(report_blocks(blocks, tables))
