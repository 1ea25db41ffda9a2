"""Queries of text forms, predicates, layout, chunks and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as s
from ..functions import tables as tb
from ..functions import text as tx
from ..operators import chunking, layout
from ..sources import fixtures as fx

_S = r"[\s\x{a0}]"


def text_forms(spark, sf_dir):
    """Normal forms of every document, as digests, and counts."""
    d = fx.read(spark, sf_dir, "documents").where("text is not null")
    sha = lambda c: F.sha2(c, 256)
    return d.select(
        "doc_id", sha(tx.flatten(F.col("text"))).alias("flat"), sha(tx.dedup_form(F.col("text"))).alias("dedup"), sha(tx.answer_form(F.col("text"))).alias("answer"),
        sha(tx.section_form(F.col("text"))).alias("section"), sha(tx.question_form(F.col("text"))).alias("question"), sha(tx.safe_filename(F.col("text"))).alias("file"),
        tx.word_count(F.col("text")).cast("long").alias("words"), s.token_estimate(F.col("text")).cast("long").alias("tokens"),
    )


FORMS_SQL = rf"""WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(173), ''), '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(trim(regexp_replace(t, '{_S}+', ' ', 'g'))) AS flat, sha256(trim(regexp_replace(regexp_replace(lower(text), '{_S}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', '', 'g'))) AS dedup,
  sha256(trim(regexp_replace(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '{_S}+', ' ', 'g'))) AS answer, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS section,
  sha256(trim(regexp_replace(lower(text), '{_S}+', ' ', 'g'))) AS question, sha256(coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'report')) AS file,
  len(list_filter(string_split_regex(text, '{_S}+'), lambda x: x <> '')) AS words, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM c"""


def _lines(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def line_predicates(spark, sf_dir):
    """Noise, decoration, borders and list marks over all lines, counted."""
    l = F.col("line")
    flags = _lines(spark, sf_dir).select("doc_id", tx.is_noise(l).alias("noise"), tx.is_decorative(l).alias("decorative"), tx.is_layout_line(F.trim(l)).alias("layout"), tx.starts_list_item(l).alias("item"))
    return flags.groupBy("doc_id").agg(*(F.count_if(c).alias(c) for c in ("noise", "decorative", "layout", "item")))


_B = r"|+\-_=—–│┃┆┊┋┇┌┐└┘├┤┬┴┼"
PREDICATES_SQL = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, line, regexp_replace(line, '^{_S}+|{_S}+$', '', 'g') AS t FROM l),
n AS (SELECT *, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^{_B}]', '', 'g')) / nullif(length(t), 0)::DOUBLE AS ratio, list_filter(string_split_regex(t, '{_S}+'), lambda x: x <> '') AS w FROM m),
p AS (SELECT *, t = '' OR ratio >= 0.25 OR regexp_full_match(t, '[\s{_B}.]{{3,}}') OR (len(w) <= 2 AND letters = 0) OR len(list_filter(w, lambda x: NOT regexp_full_match(x, '[{_B}.\d]+'))) = 0 OR letters < 5 AS noise FROM n)
SELECT doc_id, count(*) FILTER (noise) AS noise, count(*) FILTER (noise OR (len(w) < 2 AND (regexp_full_match(t, '[\d\s.,%₦N$€£+|/–—-]+') OR length(t) <= 2))) AS decorative,
  count(*) FILTER (trim(line) = '' OR regexp_full_match(trim(line), '[\s{_B}]+') OR (letters < 3 AND coalesce(ratio, 0) >= 0.40)) AS layout, count(*) FILTER (regexp_matches(line, '^(?:\d+(?:\.\d+)*[.)]?|[A-Z][.)]|[-•▪‣])\s+')) AS item FROM p GROUP BY doc_id"""


def margin_frequency(spark, sf_dir):
    """First and last lines of a source's documents that repeat, on a twenty-fifth of them."""
    d = fx.read(spark, sf_dir, "documents").where("text is not null")
    # the two lines are cut from the text by its first and last line feed, without a row for every line
    ends = F.array(F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1))
    rows = d.select(F.col("source").alias("report_id"), F.col("doc_id").alias("page_number"), F.explode(ends).alias("text"))
    return layout.repeated_margins(rows, 2, 0.04)


MARGIN_SQL = rf"""WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, source, unnest([l[1], l[-1]]) AS line FROM d),
c AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(line, '[ \t]+', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')) AS t FROM e),
f AS (SELECT DISTINCT doc_id, source, trim(regexp_replace(lower(t), '\p{{Nd}}+', '<number>', 'g')) AS form FROM c
  WHERE t <> '' AND NOT regexp_full_match(t, '[\s{_B}]+') AND NOT (length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < 3 AND length(regexp_replace(t, '[^{_B}]', '', 'g')) / length(t)::DOUBLE >= 0.40)),
n AS (SELECT source, count(DISTINCT doc_id) AS total FROM f GROUP BY 1)
SELECT source AS report_id, form, count(*) AS pages FROM f JOIN n USING (source) GROUP BY source, form, total HAVING count(*) >= greatest(2, ceil(0.04 * total))"""


def report_ids(spark, sf_dir):
    """stable ids and digests of pages read as reports."""
    p = fx.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    ticker, year = F.concat(F.lit("T"), (F.col("page_id") % 7).cast("string")), (2023 + F.col("page_id") % 3).cast("int")
    return p.select("page_id", s.report_id(ticker, year, F.concat(F.lit("Annual Report "), F.col("page_id").cast("string"))).alias("report_id"), F.length("html").cast("long").alias("character_count"), (F.trim("html") != "").alias("has_text"), F.sha2("html", 256).alias("sha256"))


IDS_SQL = "SELECT page_id, replace(lower('T' || (page_id % 7) || '_' || (2023 + page_id % 3) || '_' || 'Annual Report ' || page_id), ' ', '_') AS report_id, length(html) AS character_count, trim(html) <> '' AS has_text, sha256(html) AS sha256 FROM pages"


def chunks(spark, sf_dir):
    """Chunks of the documents' lines as paragraphs."""
    l = _lines(spark, sf_dir).where("trim(line) <> ''")
    rows = l.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("report_id"), F.col("source").alias("ticker"), F.lit(2024).alias("report_year"), (1 + F.floor(F.col("pos") / 5)).cast("int").alias("page_number"), F.col("pos").alias("para"), F.col("line").alias("text"), F.lit(None).cast("string").alias("section_title"), F.lit(False).alias("contains_table"))
    return chunking.chunk(rows).select("chunk_id", "report_id", "chunk_index", "pdf_page_start", "pdf_page_end", "word_count", "estimated_token_count", "paragraph_count", "text_sha256")


#: A chunk is a run of units, so the recursion carries where the run at hand begins (s); given: where the run that ends before unit i began.
CHUNK_SQL = rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_filter(string_split_regex(line, '{_S}+'), lambda x: x <> '') AS w FROM l WHERE trim(line) <> ''),
ls AS (SELECT doc_id, pos, w, list_filter(list_transform(string_split(regexp_replace(line, '([.!?]){_S}+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM w WHERE len(w) > 400),
lk AS (SELECT doc_id, pos, s, list_transform(s, lambda x: len(list_filter(string_split_regex(x, '{_S}+'), lambda y: y <> ''))) AS n FROM ls WHERE len(s) > 1),
lr AS (SELECT doc_id, pos, s, n, 1 AS i, s[1] AS out, n[1] AS c, false AS cut, '' AS done FROM lk
  UNION ALL SELECT doc_id, pos, s, n, i + 1, CASE WHEN c + n[i + 1] > 400 THEN s[i + 1] ELSE out || ' ' || s[i + 1] END, CASE WHEN c + n[i + 1] > 400 THEN n[i + 1] ELSE c + n[i + 1] END, c + n[i + 1] > 400, out FROM lr WHERE i < len(s)),
p AS (
  SELECT doc_id, pos, 0 AS part, line AS text FROM w WHERE len(w) <= 400
  UNION ALL SELECT doc_id, pos, i, done FROM lr WHERE cut UNION ALL SELECT doc_id, pos, len(s) + 1, out FROM lr WHERE i = len(s)
  UNION ALL SELECT doc_id, pos, i, array_to_string(w[i * 400 + 1 : i * 400 + 400], ' ') FROM (SELECT doc_id, pos, w, unnest(range(0, (len(w) + 399) // 400)) AS i FROM ls WHERE len(s) <= 1)
),
o AS (SELECT doc_id, regexp_replace(text, '^{_S}+|{_S}+$', '', 'g') AS text, 1 + pos // 5 AS page, len(list_filter(string_split_regex(text, '{_S}+'), lambda x: x <> '')) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS i FROM p),
u AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM o),
d AS (SELECT doc_id, list(text ORDER BY i) AS texts, list(page ORDER BY i) AS pages, list_concat([0], list(upto ORDER BY i)) AS t, count(*) AS n FROM u GROUP BY 1),
r AS (SELECT doc_id, t, n, 1 AS i, 1 AS s, CAST(NULL AS BIGINT) AS given FROM d
  UNION ALL SELECT doc_id, t, n, i + 1,
    CASE WHEN t[i + 2] - t[s] <= 400 THEN s
      ELSE coalesce(list_min(list_filter(range(coalesce(list_max(list_filter(range(s, i + 1), lambda x: t[i + 1] - t[x] >= 50)), s), i + 1), lambda x: t[i + 2] - t[x] <= 400)), i + 1) END,
    CASE WHEN t[i + 2] - t[s] > 400 AND t[i + 1] - t[s] >= 80 THEN s END FROM r WHERE i < n),
g AS (SELECT doc_id, given AS a, i - 1 AS b FROM r WHERE given IS NOT NULL UNION ALL SELECT doc_id, s, n FROM r WHERE i = n AND t[n + 1] - t[s] >= 80),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS ix, count(*) OVER (PARTITION BY doc_id) AS many FROM g),
rest AS (SELECT doc_id, s AS a2 FROM r WHERE i = n AND t[n + 1] - t[s] < 80),
c AS (SELECT h.doc_id, ix, a, b, CASE WHEN ix = many THEN a2 END AS a2, n, pages, array_to_string(list_concat(texts[a:b], CASE WHEN ix = many AND a2 IS NOT NULL THEN texts[a2:n] ELSE [] END), chr(10) || chr(10)) AS text
  FROM h JOIN d USING (doc_id) LEFT JOIN rest USING (doc_id))
SELECT 'r' || doc_id || '_chunk_' || lpad(ix::VARCHAR, 5, '0') || '_' || substr(sha256(text), 1, 16) AS chunk_id, 'r' || doc_id AS report_id, ix::INTEGER AS chunk_index, pages[a]::INTEGER AS pdf_page_start,
  CASE WHEN a2 IS NULL THEN pages[b] ELSE greatest(pages[a], pages[n]) END::INTEGER AS pdf_page_end, len(list_filter(string_split_regex(text, '{_S}+'), lambda x: x <> ''))::INTEGER AS word_count,
  greatest(1, ceil(length(text) / 4.0))::INTEGER AS estimated_token_count, CASE WHEN a2 IS NULL THEN b - a + 1 ELSE 1 + n - a2 + 1 END::INTEGER AS paragraph_count, sha256(text) AS text_sha256 FROM c"""


def _matrix(spark, sf_dir):
    """Suppliers of a nation as a table with a repeated header row and a collapsed row."""
    sup = fx.read(spark, sf_dir, "supplier")
    rows = sup.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.array(F.col("s_name"), F.col("s_suppkey").cast("string"), F.lit("")).alias("r")))).alias("x"))
    head = F.array(F.lit("Name"), F.lit("Key"), F.lit("Key"))
    return rows.select("s_nationkey", F.concat(F.array(head), F.transform("x", lambda v: v["r"]), F.array(F.array(F.lit("Total assets 1,234 56.7%"), F.lit(""), F.lit("")))).alias("m"))


def table_records(spark, sf_dir):
    """Matrices cleaned, repaired, and given as text and cells."""
    step, m, w = tx.step, F.col("m"), F.col("w")
    # each form of the matrix and its width are worked out once a table, or they would be made again for every row
    t = step(step(_matrix(spark, sf_dir), "m", tb.clean_matrix(m)), "w", tb.width(m))
    t = step(step(t, "m", tb.rectangular(m, w)), "m", tb.repair_rows(m, w)).where(tb.is_useful(m))
    t = step(t, "h", tb.table_headers(F.array().cast("array<string>"), m))
    t = step(t, "m", F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))))
    text = tb.retrieval_text(F.lit("Suppliers"), F.col("h"), m, F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.lit(2024), F.lit(1))
    t = step(t, "rows", tb.ordered_rows(F.col("h"), tb.records(F.col("h"), m)))
    cells = F.concat(F.lit(""), F.array_join(F.transform(F.flatten("rows"), lambda c: F.concat(c, F.lit("|"))), ""))
    return t.select("s_nationkey", F.array_join("h", ",").alias("headers"), F.size("m").cast("long").alias("rows"), F.sha2(text, 256).alias("text_sha256"), F.sha2(cells, 256).alias("cells_sha256"))


TABLE_SQL = """WITH s AS (SELECT s_nationkey, s_suppkey, s_name FROM supplier),
t AS (SELECT s_nationkey, count(*) + 1 AS rows, string_agg('Metric: ' || s_name || chr(10) || 'Key: ' || s_suppkey || chr(10), chr(10) ORDER BY s_suppkey) AS body, string_agg(s_name || '|' || s_suppkey || '||', '' ORDER BY s_suppkey) AS cells FROM s GROUP BY 1)
SELECT s_nationkey, 'Name,Key,Key_2' AS headers, rows, sha256('Company: N' || s_nationkey || chr(10) || 'Reporting year: 2024' || chr(10) || 'PDF page: 1' || chr(10) || 'Table: Suppliers' || chr(10) || chr(10) || body || chr(10) || 'Metric: Total assets' || chr(10) || 'Key: 1,234' || chr(10) || 'Key_2: 56.7%') AS text_sha256,
  sha256(cells || 'Total assets|1,234|56.7%|') AS cells_sha256 FROM t"""

QUERIES = {
    "text_forms": (text_forms, FORMS_SQL),
    "line_predicates": (line_predicates, PREDICATES_SQL),
    "margin_frequency": (margin_frequency, MARGIN_SQL),
    "report_ids": (report_ids, IDS_SQL),
    "chunks": (chunks, CHUNK_SQL),
    "table_records": (table_records, TABLE_SQL),
}
