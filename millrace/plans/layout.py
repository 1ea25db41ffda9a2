"""Queries of the layout chain and of table records, over pages laid out from the lines of ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import BORDERS, SECTION_TERMS
from ..functions.tables import TITLE_WORDS
from ..operators import layout as lo
from ..operators import report_tables as rt
from ..shared import shared_dir
from ..sources import block_files as bf
from ..sources import fixtures as fx

_S = r"[\s\x{a0}]"
_B = r"|+\-_=—–│┃┆┊┋┇┌┐└┘├┤┬┴┼"
_L = fx.LAYOUT_SQL
assert set(BORDERS) == set(_B.replace("\\", ""))


def _flat(c: str) -> str:
    """SQL of a text on one line; blocks and cells hold no line ends."""
    return rf"trim(regexp_replace(replace(replace({c}, chr(160), ' '), chr(173), ''), '{_S}+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_S}+'), lambda q: q <> '')"


def _noise(t: str) -> str:
    """SQL of noise, of a trimmed text."""
    n_letters = rf"length(regexp_replace({t}, '[^\p{{L}}]', '', 'g'))"
    return (
        rf"({t} = '' OR coalesce(length(regexp_replace({t}, '[^{_B}]', '', 'g')) / nullif(length({t}), 0)::DOUBLE, 0) >= 0.25 OR regexp_full_match({t}, '[\s{_B}.]{{3,}}') OR {n_letters} < 5 "
        rf"OR len(list_filter({_words(t)}, lambda q: NOT regexp_full_match(q, '[{_B}.\d]+'))) = 0)"
    )


def _decorative(t: str) -> str:
    return rf"({_noise(t)} OR (len({_words(t)}) < 2 AND (regexp_full_match({t}, '[\d\s.,%₦N$€£+|/–—-]+') OR length({t}) <= 2)))"


def _form(c: str) -> str:
    """SQL of a margin's form: numbers masked, case and blanks folded, '' for lines that draw borders."""
    t = f"trim(regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g'))"
    border = rf"(regexp_full_match({t}, '[\s{_B}]+') OR (length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) < 3 AND length(regexp_replace({t}, '[^{_B}]', '', 'g')) / nullif(length({t}), 0)::DOUBLE >= 0.40))"
    return rf"CASE WHEN coalesce({border}, false) THEN '' ELSE trim(regexp_replace(lower({t}), '\p{{Nd}}+', '<number>', 'g')) END"


_TERMS = " OR ".join(f"contains(lower(flat), '{t.replace(chr(39), chr(39) * 2)}')" for t in SECTION_TERMS)
#: Each step's rows as a table expression on the ones before.
_STEPS = {
    "inside": r"""tb AS (SELECT b.page_number, b.block_index FROM b JOIN t USING (page_number)
  WHERE greatest(0, least(x1, tx1) - greatest(x0, tx0)) * greatest(0, least(y1, ty1) - greatest(y0, ty0)) >= 0.50 * (x1 - x0) * (y1 - y0)),
nt AS (SELECT b.* FROM b ANTI JOIN tb USING (page_number, block_index))""",
    "margins": f"""mf AS (SELECT *, {_form("text")} AS form FROM nt),
mc AS (SELECT DISTINCT report_id, page_number, form FROM mf WHERE form <> '' AND (y0 <= 0.08 * page_height OR y1 >= (1 - 0.08) * page_height)),
mn AS (SELECT report_id, count(DISTINCT page_number) AS total FROM mc GROUP BY 1),
mr AS (SELECT report_id, form, count(*) AS pages FROM mc JOIN mn USING (report_id) GROUP BY report_id, form, total HAVING count(*) >= greatest(5, ceil(0.25 * total))),
rb AS (SELECT mf.* EXCLUDE (form) FROM mf ANTI JOIN mr USING (report_id, form))""",
    "order": rf"""cp AS (SELECT page_number, string_agg(text, chr(10) ORDER BY block_index) AS x FROM rb GROUP BY 1),
cx AS (SELECT page_number FROM cp WHERE (contains(lower(x), 'contents') OR contains(lower(x), 'in this report') OR contains(lower(x), chr(10) || 'index'))
  AND len(list_filter(string_split(x, chr(10)), lambda q: regexp_full_match(trim(q), '\d{{1,3}}'))) >= 5),
fl AS (SELECT *, {_flat("text")} AS flat FROM rb ANTI JOIN cx USING (page_number)),
us AS (SELECT *, len({_words("flat")}) AS k, x1 - x0 >= 0.70 * page_width AS wide, (x0 + x1) / 2 < page_width / 2 AS lefty FROM fl WHERE NOT {_decorative("flat")}),
c2 AS (SELECT *, sum(CASE WHEN x1 <= page_width / 2 + 0.08 * page_width THEN k ELSE 0 END) OVER w >= 40 AND sum(CASE WHEN x0 >= page_width / 2 - 0.08 * page_width THEN k ELSE 0 END) OVER w >= 40 AS two,
  min(CASE WHEN NOT wide THEN y0 END) OVER w AS top FROM us WINDOW w AS (PARTITION BY page_number)),
rg AS (SELECT *, CASE WHEN NOT two THEN 0 WHEN wide AND y0 <= coalesce(top, y0) THEN 1 WHEN wide THEN 4 WHEN lefty THEN 2 ELSE 3 END AS region FROM c2),
ro AS (SELECT * EXCLUDE (two), CASE WHEN two THEN 2 ELSE 1 END AS columns, row_number() OVER (PARTITION BY page_number ORDER BY region, y0, x0, block_index) AS place FROM rg)""",
    "headings": rf"""bf AS (SELECT *, coalesce(median(median_font_size) FILTER (median_font_size > 0) OVER (PARTITION BY page_number), 0) AS body_font FROM ro),
hd AS (SELECT *, len({_words("flat")}) BETWEEN 1 AND 16 AND length(flat) <= 160 AND NOT regexp_matches(flat, '[.,;]$') AND NOT regexp_full_match(flat, '[\d./%₦N$€£|–—\s-]+')
  AND ({_TERMS} OR (is_bold AND body_font > 0 AND max_font_size >= 1.25 * body_font)) AS heading FROM bf)""",
    "sections": """hp AS (SELECT report_id, page_number, arg_max(flat, place) FILTER (heading) AS h FROM hd GROUP BY 1, 2),
se AS (SELECT report_id, page_number, last_value(h IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY page_number) AS section_title FROM hp)""",
    "paragraphs": rf"""lg AS (SELECT *, lag(flat) OVER w AS pf, lag(heading) OVER w AS ph, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM hd WINDOW w AS (PARTITION BY page_number ORDER BY place)),
bk AS (SELECT *, pf IS NULL OR ph OR heading OR coalesce(greatest(0, least(px1, x1) - greatest(px0, x0)) / nullif(least(px1 - px0, x1 - x0), 0) < 0.45, true) OR y0 - py1 > 0.012 * page_height
  OR regexp_matches(flat, '^(?:\d+(?:\.\d+)*[.)]?|[A-Z][.)]|[-•▪‣])\s+') OR regexp_matches(pf, '[.?!:]$') AS brk FROM lg),
pp AS (SELECT *, sum(brk::INTEGER) OVER (PARTITION BY page_number ORDER BY place ROWS UNBOUNDED PRECEDING) AS para FROM bk),
pj AS (SELECT report_id, page_number, para, string_agg(flat, ' ' ORDER BY place) AS whole FROM pp WHERE NOT heading GROUP BY ALL),
pw AS (SELECT *, {_words("whole")} AS w FROM pj WHERE NOT {_noise("whole")}),
ps AS (SELECT report_id, page_number, para, w, list_filter(list_transform(string_split(regexp_replace(whole, '([.!?]){_S}+', '\1' || chr(10), 'g'), chr(10)), lambda q: trim(q)), lambda q: q <> '') AS s FROM pw WHERE len(w) > 180),
pk AS (SELECT report_id, page_number, para, s, list_transform(s, lambda q: len({_words("q")})) AS n FROM ps WHERE len(s) > 1),
pr AS (SELECT report_id, page_number, para, s, n, 1 AS i, s[1] AS out, n[1] AS c, false AS cut, '' AS done FROM pk
  UNION ALL SELECT report_id, page_number, para, s, n, i + 1, CASE WHEN c + n[i + 1] > 180 THEN s[i + 1] ELSE out || ' ' || s[i + 1] END, CASE WHEN c + n[i + 1] > 180 THEN n[i + 1] ELSE c + n[i + 1] END, c + n[i + 1] > 180, out FROM pr WHERE i < len(s)),
px AS (SELECT report_id, page_number, para, i, done AS text FROM pr WHERE cut UNION ALL SELECT report_id, page_number, para, len(s) + 1, out FROM pr WHERE i = len(s)),
pq AS (
  SELECT report_id, page_number, para, 0 AS piece, whole AS text FROM pw WHERE len(w) <= 180
  UNION ALL SELECT report_id, page_number, para, row_number() OVER (PARTITION BY page_number, para ORDER BY i) - 1, text FROM px
  UNION ALL SELECT report_id, page_number, para, unnest(range(0, (len(w) + 179) // 180)), array_to_string(unnest(list_transform(range(0, (len(w) + 179) // 180), lambda i: w[i * 180 + 1 : i * 180 + 180])), ' ') FROM ps WHERE len(s) <= 1
),
pu AS (SELECT *, len({_words("text")}) AS k FROM pq WHERE len({_words("text")}) >= 2 AND NOT {_noise("text")}),
pv AS (SELECT *, sum(k) OVER (PARTITION BY page_number) AS words FROM pu)""",
}


def _sql(*steps: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_L["pages"], _L["blocks"], _L["tables"], *(_STEPS[s] for s in steps)]) + "\n" + select


def _report(spark, sf_dir):
    return lo.report_blocks(fx.layout_blocks(spark, sf_dir), fx.page_tables(spark, sf_dir))


def _headed(spark, sf_dir):
    return lo.with_headings(lo.reading_order(lo.drop_contents_pages(_report(spark, sf_dir))))


def narrative_blocks(spark, sf_dir):
    """Blocks that no table region covers by half."""
    left = lo.drop_table_blocks(fx.layout_blocks(spark, sf_dir), fx.page_tables(spark, sf_dir))
    return left.select("report_id", "page_number", "block_index", F.sha2("text", 256).alias("sha256"))


def running_margins(spark, sf_dir):
    """Forms of running headers and footers with the number of their pages."""
    left = lo.drop_table_blocks(fx.layout_blocks(spark, sf_dir), fx.page_tables(spark, sf_dir))
    return lo.repeated_margins(lo.margin_blocks(left))


def body_blocks(spark, sf_dir):
    """Blocks that are no running header or footer."""
    return _report(spark, sf_dir).select("report_id", "page_number", "block_index")


def block_order(spark, sf_dir):
    """Number of columns and reading order on every page that is no table of contents."""
    ordered = lo.reading_order(lo.drop_contents_pages(_report(spark, sf_dir)))
    return ordered.select("report_id", "page_number", "block_index", F.col("columns").cast("long").alias("columns"), F.col("place").cast("long").alias("place"))


def block_headings(spark, sf_dir):
    """Body font of each page, and which of its blocks are headings."""
    return _headed(spark, sf_dir).select("report_id", "page_number", "block_index", "body_font", "heading")


def page_sections(spark, sf_dir):
    """The section in force at the end of every page, carried over the pages of a report."""
    return lo.page_sections(_headed(spark, sf_dir))


def page_paragraphs(spark, sf_dir):
    """Paragraphs of all reports in pieces, with their sections."""
    p = lo.read_report(fx.layout_blocks(spark, sf_dir), fx.page_tables(spark, sf_dir))
    return p.select("report_id", "page_number", F.col("para").cast("long").alias("para"), F.col("piece").cast("long").alias("piece"), F.sha2("text", 256).alias("sha256"), "section_title")


def table_titles(spark, sf_dir):
    """The nearest title above every table."""
    found = rt.nearest_titles(fx.page_tables(spark, sf_dir), fx.layout_blocks(spark, sf_dir))
    return found.select("report_id", "page_number", F.col("table_index").cast("long").alias("table_index"), "title")


_NEAR = f"""nb AS (SELECT t.report_id, t.page_number, t.table_index, {_flat("b.text")} AS title, ty0 - y1 AS d, block_index FROM t JOIN b USING (page_number)
  WHERE y1 <= ty0 AND ty0 - y1 <= 120 AND least(x1, tx1) - greatest(x0, tx0) > 0),
nx AS (SELECT report_id, page_number, table_index, arg_min(title, (d, block_index)) AS title FROM nb WHERE title <> '' AND len({_words("title")}) <= 20 GROUP BY ALL)"""


def table_records_whole(spark, sf_dir):
    """Records of all tables, with id, title, page and text."""
    r = rt.table_records(fx.page_tables(spark, sf_dir), fx.layout_blocks(spark, sf_dir))
    named = F.transform("table_data.rows", lambda x: F.array_join(F.transform("table_data.headers", lambda h: F.concat(h, F.lit("="), F.element_at(x, h))), "|"))
    return r.select(
        "table_id", "report_id", "ticker", F.col("report_year").cast("long").alias("report_year"), "pdf_page_number", F.col("table_index").cast("long").alias("table_index"), "table_title",
        F.col("row_count").cast("long").alias("row_count"), F.col("column_count").cast("long").alias("column_count"), F.array_join("table_data.headers", "|").alias("headers"),
        F.sha2(F.array_join(named, "\n"), 256).alias("rows_sha256"), F.col("character_count").cast("long").alias("character_count"), F.col("word_count").cast("long").alias("word_count"), "text_sha256",
    )


_VALUE = r"(?i)\(?[-–—]?(₦|N|\$|£|€)?\d[\d,]*(\.\d+)?%?\)?|[-–—]|N/?A"
_TITLED = " OR ".join(f"contains(lower(x), '{w}')" for w in TITLE_WORDS)
_K = "report_id, page_number, table_index"
_RECORDS = rf"""{_NEAR},
m0 AS (SELECT {_K}, detected, unnest(matrix) AS r, generate_subscripts(matrix, 1) AS i FROM t),
m1 AS (SELECT {_K}, detected, i, list_transform(r, lambda c: {_flat("coalesce(c, '')")}) AS r FROM m0),
m2 AS (SELECT *, max(len(r)) OVER (PARTITION BY {_K}) AS w FROM m1 WHERE len(list_filter(r, lambda c: c <> '')) > 0),
m3 AS (SELECT {_K}, detected, i, w, list_concat(r, list_transform(range(len(r), w), lambda q: '')) AS r FROM m2),
m4 AS (SELECT *, list_filter(string_split(r[1], ' '), lambda c: regexp_full_match(c, '{_VALUE}')) AS found FROM m3),
m5 AS (SELECT *, found[greatest(len(found) - w + 2, 1) : len(found)] AS vals, array_to_string(found[greatest(len(found) - w + 2, 1) : len(found)], ' ') AS tail FROM m4),
m6 AS (SELECT {_K}, detected, i, w, CASE WHEN w > 1 AND len(list_filter(r[2:], lambda c: c <> '')) = 0 AND len(found) >= w - 1 AND ends_with(r[1], tail) AND trim(r[1][: length(r[1]) - length(tail)]) <> ''
  THEN list_concat([trim(r[1][: length(r[1]) - length(tail)])], vals) ELSE r END AS r FROM m5),
m7 AS (SELECT {_K}, any_value(detected) AS detected, any_value(w) AS w, list(r ORDER BY i) AS m FROM m6 GROUP BY {_K}),
m8 AS (SELECT * FROM m7 WHERE len(m) >= 2 AND w >= 2 AND len(list_filter(flatten(m), lambda c: c <> '')) >= 4),
h0 AS (SELECT *, CASE WHEN len(list_filter(coalesce(detected, []), lambda c: trim(c) <> '')) > 0 THEN list_transform(detected, lambda c: {_flat("c")}) ELSE m[1] END AS d FROM m8),
h1 AS (SELECT *, list_transform(range(1, w + 1), lambda i: CASE WHEN i > len(d) OR trim(coalesce(d[i], '')) = '' THEN 'column_' || i ELSE trim(d[i]) END) AS nm FROM h0),
h2 AS (SELECT *, list_transform(range(1, w + 1), lambda i: nm[i] || CASE WHEN len(list_filter(nm[:i], lambda c: c = nm[i])) > 1 THEN '_' || len(list_filter(nm[:i], lambda c: c = nm[i])) ELSE '' END) AS un FROM h1),
h3 AS (SELECT {_K}, w, m, list_transform(range(1, w + 1), lambda i: CASE WHEN i = 1 AND starts_with(un[1], 'column_') THEN 'Metric' ELSE un[i] END) AS h FROM h2),
h4 AS (SELECT *, list_filter(range(1, w + 1), lambda i: NOT (starts_with(lower(h[i]), 'column_') AND m[1][i] = '')) AS cmp FROM h3),
h5 AS (SELECT {_K}, w, h, CASE WHEN len(cmp) > 0 AND len(list_filter(cmp, lambda i: lower(h[i]) = lower(m[1][i]))) >= 0.80 * len(cmp) THEN m[2:] ELSE m END AS m FROM h4),
r0 AS (SELECT *, list_filter(list_transform(list_filter(list_transform(m[:12], lambda r: list_filter(r, lambda c: c <> '')), lambda r: len(r) = 1), lambda r: r[1]), lambda x: {_TITLED})[1] AS own FROM h5 WHERE len(m) > 0),
r1 AS (SELECT r0.*, coalesce(own, title) AS table_title FROM r0 LEFT JOIN nx USING (page_number, table_index)),
r2 AS (SELECT *, list_transform(m, lambda r: array_to_string(list_concat(list_concat([CASE WHEN trim(r[1]) <> '' THEN 'Metric: ' || trim(r[1]) ELSE 'Table row:' END],
    list_transform(list_filter(range(1, w + 1), lambda i: r[i] <> '' AND NOT (i = 1 AND trim(r[1]) <> '')), lambda i: h[i] || ': ' || r[i])), ['']), chr(10))) AS body FROM r1),
r3 AS (SELECT *, regexp_replace('Company: ' || report_id || chr(10) || 'Reporting year: 2024' || chr(10) || 'PDF page: ' || page_number || chr(10) || CASE WHEN coalesce(table_title, '') <> '' THEN 'Table: ' || table_title || chr(10) ELSE '' END || chr(10)
  || array_to_string(body, chr(10)), '^{_S}+|{_S}+$', '', 'g') AS rag FROM r2),
r4 AS (SELECT *, '[' || array_to_string(list_transform(m, lambda r: '[' || array_to_string(list_transform(r, lambda c: '"' || replace(replace(c, '\', '\\'), '"', '\"') || '"'), ', ') || ']'), ', ') || ']' AS js FROM r3),
r5 AS (SELECT *, list_transform(m, lambda r: array_to_string(list_transform(range(1, w + 1), lambda i: h[i] || '=' || r[list_max(list_filter(range(1, w + 1), lambda j: h[j] = h[i]))]), '|')) AS named FROM r4)
SELECT report_id || '_p' || lpad(page_number::VARCHAR, greatest(4, length(page_number::VARCHAR))::INTEGER, '0') || '_table_' || lpad(table_index::VARCHAR, 2, '0') || '_' || substr(sha256(report_id || '|' || page_number || '|' || table_index || '|' || js), 1, 16) AS table_id,
  report_id, report_id AS ticker, 2024::BIGINT AS report_year, page_number AS pdf_page_number, table_index::BIGINT AS table_index, table_title, len(m)::BIGINT AS row_count, w::BIGINT AS column_count, array_to_string(h, '|') AS headers,
  sha256(array_to_string(named, chr(10))) AS rows_sha256, length(rag)::BIGINT AS character_count, len({_words("rag")})::BIGINT AS word_count, sha256(rag) AS text_sha256 FROM r5"""

def block_files(spark, sf_dir):
    """Blocks written as JSON lines, the footers cut short, and read back: pages, blocks and lost lines of every report."""
    b = fx.layout_blocks(spark, sf_dir).select("report_id", "page_number", "block_index", "text")
    line = F.to_json(F.struct("*"))
    cut = F.when(F.col("text").rlike("^Page [0-9]+ of the report$"), F.expr("substring(l, 1, length(l) - 1)")).otherwise(F.col("l"))
    folder = f"{shared_dir(spark)}/millrace/blocks-{uuid.uuid4().hex}"
    b.withColumn("l", line).select(cut.alias("value")).write.text(folder)
    rows = bf.read_blocks(spark, folder, pattern="part-*", splitBytes=4 << 20)
    lost = rows.agg(F.count_if(F.col("error").isNotNull()).alias("lost"))
    return bf.report_counts(rows).crossJoin(F.broadcast(lost))


QUERIES = {
    "block_files": (block_files, _sql(select="SELECT report_id, count(DISTINCT page_number) AS pages, count(*) AS blocks, (SELECT count(*) FROM b WHERE regexp_matches(text, '^Page [0-9]+ of the report$')) AS lost FROM b WHERE NOT regexp_matches(text, '^Page [0-9]+ of the report$') GROUP BY 1")),
    "narrative_blocks": (narrative_blocks, _sql("inside", select="SELECT report_id, page_number, block_index::INTEGER AS block_index, sha256(text) AS sha256 FROM nt")),
    "running_margins": (running_margins, _sql("inside", "margins", select="SELECT report_id, form, pages FROM mr")),
    "body_blocks": (body_blocks, _sql("inside", "margins", select="SELECT report_id, page_number, block_index::INTEGER AS block_index FROM rb")),
    "block_order": (block_order, _sql("inside", "margins", "order", select="SELECT report_id, page_number, block_index::INTEGER AS block_index, columns::BIGINT AS columns, place FROM ro")),
    "block_headings": (block_headings, _sql("inside", "margins", "order", "headings", select="SELECT report_id, page_number, block_index::INTEGER AS block_index, body_font::DOUBLE AS body_font, heading FROM hd")),
    "page_sections": (page_sections, _sql("inside", "margins", "order", "headings", "sections", select="SELECT report_id, page_number, section_title FROM se")),
    "page_paragraphs": (page_paragraphs, _sql(*_STEPS, select="SELECT pv.report_id, page_number, para::BIGINT AS para, piece::BIGINT AS piece, sha256(text) AS sha256, section_title FROM pv LEFT JOIN se USING (page_number) WHERE words >= 10")),
    "table_titles": (table_titles, f"WITH {_L['pages']},\n{_L['blocks']},\n{_L['tables']},\n{_NEAR}\nSELECT report_id, page_number, table_index::BIGINT AS table_index, title FROM nx"),
    "table_records_whole": (table_records_whole, f"WITH {_L['pages']},\n{_L['blocks']},\n{_L['tables']},\n{_RECORDS}"),
}
