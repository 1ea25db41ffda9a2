"""Stand-ins for document collections and monitoring logs over the test tables.

Each view has a Spark form and SQL of the same rows (``SQL``, common table
expressions to put before a query). They only project, so filters and columns
are pushed into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import sampled, token_cost

MODELS = ("gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-3.1-flash-lite", "unknown-model")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as narrative retrieval rows."""
    d = read(spark, sf_dir, "documents").where("text is not null and text <> ''")
    year, page = (2023 + F.col("doc_id") % 3).cast("int"), (1 + F.col("doc_id") % 50).cast("int")
    key = F.col("doc_id").cast("string")
    return d.select(
        F.concat(F.lit("narrative:"), key).alias("document_id"), key.alias("source_id"), F.lit("narrative").alias("content_type"), F.concat_ws("_", "source", year.cast("string")).alias("report_id"),
        F.col("source").alias("ticker"), year.alias("report_year"), page.alias("page_start"), page.alias("page_end"), F.col("lang").alias("section_title"), "text",
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as table retrieval rows."""
    p = read(spark, sf_dir, "part")
    year, page, key = (2023 + F.col("p_partkey") % 3).cast("int"), (1 + F.col("p_partkey") % 50).cast("int"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("Company: "), F.col("p_brand"), F.lit("\nReporting year: "), year.cast("string"), F.lit("\nPDF page: "), page.cast("string"), F.lit("\nTable: "), F.col("p_type"),
        F.lit("\n\nMetric: "), F.col("p_name"), F.lit("\nsize: "), F.col("p_size").cast("string"),
    )
    return p.select(
        F.concat(F.lit("table:"), key).alias("document_id"), key.alias("source_id"), F.lit("table").alias("content_type"), F.concat_ws("_", "p_brand", year.cast("string")).alias("report_id"),
        F.col("p_brand").alias("ticker"), year.alias("report_year"), page.alias("page_start"), page.alias("page_end"), F.col("p_type").alias("section_title"), text.alias("text"),
    )


def retrieval_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(spark, sf_dir).unionByName(tables(spark, sf_dir))


def with_embeddings(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``embedding``, null for documents without one."""
    e = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("narrative:"), F.col("vec_id").cast("string")).alias("document_id"), "embedding")
    return docs.join(e, "document_id", "left")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answered questions."""
    e = read(spark, sf_dir, "events").withColumn("k", F.coalesce(F.regexp_extract("props", r"(\d+)", 1).try_cast("int"), F.lit(0)))
    key = F.col("event_id").cast("string")
    failed = F.col("event_type") == "error"
    take = sampled(key, 0.25)
    judged = take & ~failed
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % 4 + 1).cast("int"))
    cost = lambda m, i, o, t: F.round(token_cost(m, i, o, t), 10)
    return e.select(
        key.alias("response_id"), F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("question "), key).alias("question"),
        F.when(F.col("event_id") % 2 == 0, "rag").otherwise("agent").alias("pipeline"), model.alias("model"), F.when(failed, "failed").otherwise("completed").alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"), (F.col("value") / 10).alias("total_latency_seconds"),
        (F.col("k") * 10).alias("input_tokens"), (F.col("k") * 5).alias("output_tokens"), F.col("k").alias("thinking_tokens"),
        cost(model, F.col("k") * 10, F.col("k") * 5, F.col("k")).alias("application_cost_usd"),
        take.alias("judge_sampled"), F.when(failed, "not_run").when(take, "completed").otherwise("skipped").alias("judge_status"),
        F.when(judged, (F.col("k") % 11) / 10.0).alias("relevance_score"), F.when(judged, cost(F.lit(MODELS[1]), F.col("k") * 20, F.col("k"), F.lit(0))).otherwise(0.0).alias("judge_cost_usd"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings, several for some responses: a click likes and a purchase dislikes one of 500 responses."""
    e = read(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    return e.select((F.col("event_id") % 500).cast("string").alias("response_id"), F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("rating"), F.col("ts").cast("timestamp_ntz").alias("rated_at"), "event_id")


SQL = {
    "rd": r"""rd AS (
  SELECT 'narrative:' || doc_id AS document_id, CAST(doc_id AS VARCHAR) AS source_id, 'narrative' AS content_type, source || '_' || (2023 + doc_id % 3) AS report_id, source AS ticker,
    CAST(2023 + doc_id % 3 AS INTEGER) AS report_year, CAST(1 + doc_id % 50 AS INTEGER) AS page_start, CAST(1 + doc_id % 50 AS INTEGER) AS page_end, lang AS section_title, text
  FROM documents WHERE text IS NOT NULL AND text <> ''
  UNION ALL
  SELECT 'table:' || p_partkey, CAST(p_partkey AS VARCHAR), 'table', p_brand || '_' || (2023 + p_partkey % 3), p_brand,
    CAST(2023 + p_partkey % 3 AS INTEGER), CAST(1 + p_partkey % 50 AS INTEGER), CAST(1 + p_partkey % 50 AS INTEGER), p_type,
    'Company: ' || p_brand || chr(10) || 'Reporting year: ' || (2023 + p_partkey % 3) || chr(10) || 'PDF page: ' || (1 + p_partkey % 50) || chr(10) || 'Table: ' || p_type
      || chr(10) || chr(10) || 'Metric: ' || p_name || chr(10) || 'size: ' || p_size
  FROM part)""",
    "inter": r"""ev AS (
  SELECT *, coalesce(TRY_CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER), 0) AS k, event_type = 'error' AS failed,
    CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295::DOUBLE < 0.25 AS take FROM events),
pr AS (SELECT * FROM (VALUES (0, 'gemini-2.5-flash', 0.30::DOUBLE, 2.50::DOUBLE), (1, 'gemini-2.5-flash-lite', 0.10::DOUBLE, 0.40::DOUBLE), (2, 'gemini-3.1-flash-lite', 0.25::DOUBLE, 1.50::DOUBLE), (3, 'unknown-model', 0::DOUBLE, 0::DOUBLE)) t(i, model, a, b)),
inter AS (
  SELECT CAST(event_id AS VARCHAR) AS response_id, CAST(user_id AS VARCHAR) AS session_id, 'question ' || event_id AS question, CASE WHEN event_id % 2 = 0 THEN 'rag' ELSE 'agent' END AS pipeline,
    pr.model, CASE WHEN failed THEN 'failed' ELSE 'completed' END AS status, CAST(ts AS TIMESTAMP) AS created_at, value / 10 AS total_latency_seconds, k * 10 AS input_tokens, k * 5 AS output_tokens, k AS thinking_tokens,
    round(k * 10 / 1e6::DOUBLE * a + (k * 5 + k) / 1e6::DOUBLE * b, 10) AS application_cost_usd, take AS judge_sampled,
    CASE WHEN failed THEN 'not_run' WHEN take THEN 'completed' ELSE 'skipped' END AS judge_status,
    CASE WHEN take AND NOT failed THEN (k % 11) / 10::DOUBLE END AS relevance_score,
    CASE WHEN take AND NOT failed THEN round(k * 20 / 1e6::DOUBLE * 0.10::DOUBLE + k / 1e6::DOUBLE * 0.40::DOUBLE, 10) ELSE 0::DOUBLE END AS judge_cost_usd
  FROM ev JOIN pr ON pr.i = ev.event_id % 4)""",
    "fb": r"""fe AS (
  SELECT CAST(event_id % 500 AS VARCHAR) AS response_id, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS rating, CAST(ts AS TIMESTAMP) AS rated_at, event_id FROM events WHERE event_type IN ('click', 'purchase')),
fb AS (
  SELECT response_id, arg_max(rating, {'a': rated_at, 'e': event_id}) AS rating, min(rated_at) AS created_at, max(rated_at) AS updated_at FROM fe GROUP BY response_id)""",
}


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source: lines, and the rows they take in one column or, for every third page, in two."""
    d = read(spark, sf_dir, "documents").where("text is not null and doc_id is not null").withColumn("lines", F.split("text", "\n", -1)).withColumn("n", F.size("lines"))
    d = d.withColumn("two", (F.col("doc_id") % 3 == 0) & (F.col("n") >= 5)).withColumn("half", F.expr("n div 2").cast("int")).withColumn("lang", F.coalesce("lang", F.lit("xx")))
    d = d.withColumn("rows", F.when(F.col("two"), F.col("half") + 1).otherwise(F.col("n"))).withColumn("height", 40.0 * (F.col("rows") + 5))
    return d.select(F.col("source").alias("report_id"), F.col("doc_id").alias("page_number"), "lang", "n_chars", "lines", "n", "two", "half", "rows", "height")


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks: the lines of each page below a running header and a heading, above a footer."""
    p = _page_lines(spark, sf_dir)
    page = F.col("page_number")

    def block(text, x0, y0, x1, y1, font=10.0, median=10.0, bold=False):
        number = lambda v: v if not isinstance(v, float) else F.lit(v)
        cols = {"text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "max_font_size": font, "median_font_size": median, "is_bold": bold}
        return F.struct(*((number(c) if not isinstance(c, bool) else F.lit(c)).alias(name) for name, c in cols.items()))

    def line(text, i):
        row = F.when(F.col("two") & (i > 0), (i - 1) % F.col("half") + 1).otherwise(i)
        right, left = F.col("two") & (i > F.col("half")), F.col("two") & (i > 0) & (i <= F.col("half"))
        x0 = F.when(right, 310.0).otherwise(30.0) + F.when(i % 5 == 4, 12.0).otherwise(0.0)
        y0 = 80.0 + 40.0 * row
        large = i % 7 == 3
        return block(text, x0, y0, F.when(left, 290.0).otherwise(570.0), y0 + F.when(i % 4 == 0, 30.0).otherwise(39.5), F.when(large, 12.5).otherwise(10.0), F.when(i % 3 == 0, 9.5).otherwise(10.0), large)

    some = lambda on, b: F.when(on, F.array(b)).otherwise(F.slice(F.array(b), 1, 0))
    header = some(page % 5 != 0, block(F.concat("report_id", F.lit(" annual report "), page.cast("string")), 200.0, 4.0, 400.0, 20.0))
    heading = some(page % 4 >= 2, block(F.when(page % 4 == 2, F.concat(F.lit("Notes to the "), "lang")).otherwise(F.concat("lang", F.lit(" overview of "), "report_id")), 30.0, 44.0, 570.0, 64.0, 14.0, 14.0, True))
    footer = F.array(block(F.concat(F.lit("Page "), page.cast("string"), F.lit(" of the report")), 30.0, F.col("height") - 30.0, 570.0, F.col("height") - 14.0))
    blocks = p.select(*("report_id", "page_number", "height"), F.posexplode(F.concat(header, heading, F.transform("lines", line), footer)).alias("block_index", "b"))
    return blocks.select("report_id", "page_number", "block_index", "b.text", "b.x0", "b.y0", "b.x1", "b.y1", F.lit(600.0).alias("page_width"), F.col("height").alias("page_height"), "b.max_font_size", "b.median_font_size", "b.is_bold")


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of every fourth page: one of the lines' phrases over the middle of the page, and on half of these pages one of numbered lines at its end."""
    p = _page_lines(spark, sf_dir).where("page_number % 4 = 1")
    kind = F.expr("(page_number div 4) % 3")
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    phrases = F.transform("lines", lambda x: F.split(x, ", ", -1))
    first = F.when(kind == 0, words("", "Value")).when(kind == 1, words("item", "Item_2", " note")).otherwise(words("Name", "", "Name"))
    title = F.when(F.col("page_number") % 8 == 1, F.array(F.array(F.lit(""), F.concat(F.lit("Statement of "), "lang")))).otherwise(F.expr("cast(array() as array<array<string>>)"))
    w = F.greatest(F.size(first), F.array_max(F.transform(phrases, F.size)))
    total = F.array(F.concat(F.lit("Total "), "lang", F.repeat(F.concat(F.lit(" "), F.col("n_chars").cast("string")), w - 1)))
    top = 95.0 + 40.0 * F.expr("rows div 3")
    end = 60.0 + 40.0 * F.col("rows")
    numbered = F.transform("lines", lambda x, i: F.array(F.concat(F.lit("line "), i.cast("string")), x, F.length(x).cast("string")))
    # columns of their own, so that what is not asked for is not made
    t = p.withColumn("table_index", F.explode(F.when(F.col("page_number") % 8 == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    either = lambda one, two: F.when(F.col("table_index") == 1, one).otherwise(two)
    return t.select(
        "report_id", F.col("report_id").alias("ticker"), F.lit(2024).alias("report_year"), "page_number", "table_index", F.lit(20.0).alias("tx0"), either(top, end).alias("ty0"),
        either(F.when(F.col("two"), 300.0).otherwise(580.0), F.lit(580.0)).alias("tx1"), either(top + 40.0 * F.greatest(F.lit(1), F.expr("rows div 3")), end + 40.0).alias("ty1"),
        either(F.when(kind == 1, words("Item", "Item", "Note")).when(kind == 2, words("", " ")), words("", "text", "length")).alias("detected"),
        either(F.concat(F.array(first), title, phrases, F.array(total)), numbered).alias("matrix"),
    )


_PAGE_LINES = """pl AS (SELECT source AS report_id, doc_id AS page_number, coalesce(lang, 'xx') AS lang, n_chars, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
pn AS (SELECT *, len(lines) AS n, page_number % 3 = 0 AND len(lines) >= 5 AS two, len(lines) // 2 AS half FROM pl),
pg AS (SELECT *, CASE WHEN two THEN half + 1 ELSE n END AS rows, 40.0::DOUBLE * (CASE WHEN two THEN half + 1 ELSE n END + 5) AS height FROM pn)"""

LAYOUT_SQL = {
    "pages": _PAGE_LINES,
    "blocks": """bl AS (SELECT report_id, page_number, two, half, height, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS i FROM pg),
br AS (SELECT *, CASE WHEN two AND i > 0 THEN (i - 1) % half + 1 ELSE i END AS r FROM bl),
bu AS (
  SELECT report_id, page_number, height, i + 2 AS o, text, CASE WHEN two AND i > half THEN 310.0 ELSE 30.0 END::DOUBLE + CASE WHEN i % 5 = 4 THEN 12.0 ELSE 0.0 END::DOUBLE AS x0, 80.0::DOUBLE + 40.0::DOUBLE * r AS y0,
    CASE WHEN two AND i > 0 AND i <= half THEN 290.0 ELSE 570.0 END::DOUBLE AS x1, 80.0::DOUBLE + 40.0::DOUBLE * r + CASE WHEN i % 4 = 0 THEN 30.0 ELSE 39.5 END::DOUBLE AS y1,
    CASE WHEN i % 7 = 3 THEN 12.5 ELSE 10.0 END::DOUBLE AS max_font_size, CASE WHEN i % 3 = 0 THEN 9.5 ELSE 10.0 END::DOUBLE AS median_font_size, i % 7 = 3 AS is_bold FROM br
  UNION ALL SELECT report_id, page_number, height, 0, report_id || ' annual report ' || page_number, 200, 4, 400, 20, 10, 10, false FROM pg WHERE page_number % 5 <> 0
  UNION ALL SELECT report_id, page_number, height, 1, CASE WHEN page_number % 4 = 2 THEN 'Notes to the ' || lang ELSE lang || ' overview of ' || report_id END, 30, 44, 570, 64, 14, 14, true FROM pg WHERE page_number % 4 >= 2
  UNION ALL SELECT report_id, page_number, height, n + 2, 'Page ' || page_number || ' of the report', 30, height - 30, 570, height - 14, 10, 10, false FROM pg
),
b AS (SELECT * EXCLUDE (o, height), row_number() OVER (PARTITION BY page_number ORDER BY o) - 1 AS block_index, 600.0::DOUBLE AS page_width, height AS page_height FROM bu)""",
    "tables": """tp AS (SELECT *, (page_number // 4) % 3 AS kind, list_transform(lines, lambda x: string_split(x, ', ')) AS phrases FROM pg WHERE page_number % 4 = 1),
tf AS (SELECT *, CASE kind WHEN 0 THEN ['', 'Value'] WHEN 1 THEN ['item', 'Item_2', ' note'] ELSE ['Name', '', 'Name'] END AS head, 95.0::DOUBLE + 40.0::DOUBLE * (rows // 3) AS top FROM tp),
tw AS (SELECT *, greatest(len(head), list_max(list_transform(phrases, lambda x: len(x)))) AS w FROM tf),
t AS (
  SELECT report_id, page_number, 1 AS table_index, 20.0::DOUBLE AS tx0, top AS ty0, CASE WHEN two THEN 300.0 ELSE 580.0 END::DOUBLE AS tx1, top + 40.0::DOUBLE * greatest(1, rows // 3) AS ty1,
    CASE kind WHEN 1 THEN ['Item', 'Item', 'Note'] WHEN 2 THEN ['', ' '] END AS detected,
    list_concat(list_concat(list_concat([head], CASE WHEN page_number % 8 = 1 THEN [['', 'Statement of ' || lang]] ELSE [] END), phrases), [['Total ' || lang || repeat(' ' || n_chars, w - 1)]]) AS matrix FROM tw
  UNION ALL SELECT report_id, page_number, 2, 20, 60.0::DOUBLE + 40.0::DOUBLE * rows, 580, 100.0::DOUBLE + 40.0::DOUBLE * rows, ['', 'text', 'length'],
    list_transform(lines, lambda x, i: ['line ' || (i - 1), x, length(x)::VARCHAR]) FROM tw WHERE page_number % 8 = 5
)""",
}


def judge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of judgements: questions, starts, and outcomes of which some come late, twice or never."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    later = lambda minutes: F.col("ts") + F.make_dt_interval(mins=minutes)
    minutes = ((F.col("id") * 37) % 1800).cast("int")
    outcome = F.when(F.col("id") % 7 == 0, "skipped").when(F.col("id") % 7 == 1, "judge_failed").otherwise("judged")
    row = lambda on, at, kind, score: F.when(on, F.struct(at.alias("at"), kind.alias("kind"), score.cast("double").alias("score")))
    rows = F.array(
        row(F.lit(True), F.col("ts"), F.when(F.col("event_type") == "error", "request_failed").otherwise("asked"), F.lit(None)),
        row(F.col("id") % 3 != 0, later((F.col("id") % 50).cast("int")), F.lit("judging"), F.lit(None)),
        row(F.col("id") % 5 != 0, later(minutes), outcome, F.when(outcome == "judged", (F.col("id") % 101) / 100)),
        row(F.col("id") % 11 == 0, later(minutes + 10), F.lit("judged"), F.lit(0.25)),
    )
    return e.select(F.col("id").cast("string").alias("response_id"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("response_id", "x.*")


JUDGE_EVENTS_SQL = """je AS (SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, event_type, (event_id * 37) % 1800 AS mins, CASE event_id % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'judge_failed' ELSE 'judged' END AS o FROM events),
jl AS (
  SELECT id, ts AS w, CASE WHEN event_type = 'error' THEN 'request_failed' ELSE 'asked' END AS kind, NULL::DOUBLE AS score FROM je
  UNION ALL SELECT id, ts + to_minutes(id % 50), 'judging', NULL FROM je WHERE id % 3 <> 0
  UNION ALL SELECT id, ts + to_minutes(mins), o, CASE WHEN o = 'judged' THEN (id % 101) / 100.0::DOUBLE END FROM je WHERE id % 5 <> 0
  UNION ALL SELECT id, ts + to_minutes(mins + 10), 'judged', 0.25 FROM je WHERE id % 11 = 0
)"""


def counting_embedder():
    """A deterministic model for queries and tests: three counts of a text. Every seventh length is refused; a batch's first call fails where a length is a multiple of five."""
    seen = set()

    def embed(texts):
        if any(len(t) % 5 == 0 for t in texts) and len(texts) > 1 and (key := (len(texts), hash(texts[0]))) not in seen:
            seen.add(key)
            raise ConnectionError("busy")
        return [ValueError("refused") if len(t) % 7 == 0 else [float(len(t)), float(t.count("e")), float(t.count("\n"))][: 2 if len(t) % 11 == 0 else 3] for t in texts]

    return embed


def length_judge():
    """A deterministic judge: scores by length, now and then out of range or not JSON."""

    def judge(pairs):
        if any(lang == "de" and len(text) % 13 == 0 for text, lang in pairs):
            raise TimeoutError("no answer")
        return ["none" if len(text) % 17 == 0 else f'{{"relevance": {{"score": {(len(text) % 120) / 100}, "reason": "{lang}"}}}}' for text, lang in pairs]

    return judge
