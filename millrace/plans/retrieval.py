"""Queries of the retrieval core, corpus statistics and deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import STOP_WORDS, simple_tokens
from ..functions.text import page_label
from ..operators import dedup, index, search
from ..operators.chunking import slices
from ..sources import fixtures as fx

QUERY = "that was"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.with_embeddings(fx.retrieval_documents(spark, sf_dir), spark, sf_dir)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding of vector 0 stands in for an encoded question: one row."""
    return list(fx.read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


SHORT = ["document_id", "rank", "score", "content_type", "ticker", "report_year"]


def keyword_search(spark, sf_dir):
    """Two-word keyword search, top 10."""
    return search.keyword_search(fx.retrieval_documents(spark, sf_dir), QUERY, 10, analyzer="simple").select(*SHORT)


def keyword_search_filtered(spark, sf_dir):
    """R1 with P1: one word, ticker and year."""
    return search.keyword_search(fx.retrieval_documents(spark, sf_dir), "the", 10, ticker="src1", report_year=2024, analyzer="simple").select(*SHORT)


def vector_search(spark, sf_dir):
    """Cosine, top 10."""
    return search.vector_search(_docs(spark, sf_dir), query_vector(spark, sf_dir), 10).select(*SHORT)


def vector_search_filtered(spark, sf_dir):
    """R2 with P1."""
    return search.vector_search(_docs(spark, sf_dir), query_vector(spark, sf_dir), 10, report_year=2024).select(*SHORT)


def hybrid_search(spark, sf_dir):
    """Reciprocal rank fusion of 30 and 30, top 10."""
    out = search.retrieve(_docs(spark, sf_dir), QUERY, mode="hybrid", vector=query_vector(spark, sf_dir), analyzer="simple")
    return out.select("document_id", "rank", "rrf_score", "score", "keyword_rank", "vector_rank", "keyword_score", "vector_score")


_POST = r"""tok AS (
  SELECT document_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM rd),
post AS (
  SELECT document_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM tok)"""

#: Two words: minimal covers are neighbouring occurrences of different words.
_KW = _POST + """,
occ AS (
  SELECT *, lag(t) OVER (PARTITION BY document_id ORDER BY pos) AS pt, lag(pos) OVER (PARTITION BY document_id ORDER BY pos) AS pp FROM post WHERE t IN ('that', 'was')),
kw0 AS (
  SELECT document_id, round(sum(CASE WHEN pt <> t THEN 0.1::DOUBLE / (pos - pp) ELSE 0 END), 9) AS score FROM occ GROUP BY document_id HAVING count(DISTINCT t) = 2),
kw AS (
  SELECT document_id, score, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM kw0)"""
_VEC = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
vec0 AS (
  SELECT rd.document_id, rd.report_year, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS score
  FROM rd JOIN embeddings e ON rd.document_id = 'narrative:' || e.vec_id, q)"""
_SHORT = "rd.document_id, CAST(rank AS INTEGER) AS rank, score, content_type, ticker, rd.report_year"

KEYWORD_SQL = f"WITH {fx.SQL['rd']}, {_KW} SELECT {_SHORT} FROM kw JOIN rd USING (document_id) WHERE rank <= 10"
KEYWORD_FILTERED_SQL = f"""WITH {fx.SQL['rd']}, {_POST}, kw AS (
  SELECT document_id, round(count(*) * 0.1::DOUBLE, 9) AS score, row_number() OVER (ORDER BY round(count(*) * 0.1::DOUBLE, 9) DESC, document_id) AS rank
  FROM post JOIN rd USING (document_id) WHERE t = 'the' AND ticker = 'src1' AND report_year = 2024 GROUP BY document_id)
SELECT {_SHORT} FROM kw JOIN rd USING (document_id) WHERE rank <= 10"""
VECTOR_SQL = f"""WITH {fx.SQL['rd']}, {_VEC}, vec AS (SELECT document_id, score, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM vec0)
SELECT {_SHORT} FROM vec JOIN rd USING (document_id) WHERE rank <= 10"""
VECTOR_FILTERED_SQL = VECTOR_SQL.replace("FROM vec0)", "FROM vec0 WHERE report_year = 2024)")
HYBRID_SQL = f"""WITH {fx.SQL['rd']}, {_KW}, {_VEC}, vec AS (SELECT document_id, score, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM vec0),
f AS (
  SELECT coalesce(k.document_id, v.document_id) AS document_id, k.rank AS kr, v.rank AS vr, k.score AS ks, v.score AS vs,
    round(coalesce(1::DOUBLE / (60 + k.rank), 0) + coalesce(1::DOUBLE / (60 + v.rank), 0), 9) AS rrf_score
  FROM (SELECT * FROM kw WHERE rank <= 30) k FULL JOIN (SELECT * FROM vec WHERE rank <= 30) v ON k.document_id = v.document_id),
r AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, kr NULLS LAST, vr NULLS LAST) AS rank FROM f)
SELECT document_id, CAST(rank AS INTEGER) AS rank, rrf_score, coalesce(ks, vs) AS score, CAST(kr AS INTEGER) AS keyword_rank, CAST(vr AS INTEGER) AS vector_rank, ks AS keyword_score, vs AS vector_score
FROM r WHERE rank <= 10"""


def context_block(spark, sf_dir):
    """The context of the five best keyword results."""
    return search.build_context(search.keyword_search(fx.retrieval_documents(spark, sf_dir), QUERY, 5, analyzer="simple"))


CONTEXT_SQL = f"""WITH {fx.SQL['rd']}, {_KW} SELECT string_agg('[SOURCE ' || rank || ']' || chr(10) || 'Type: ' || content_type || chr(10) || 'Ticker: ' || ticker || chr(10) || 'Report year: ' || report_year || chr(10)
  || 'Pages: ' || page_start || '-' || page_end || chr(10) || CASE WHEN section_title <> '' THEN 'Section: ' || section_title || chr(10) ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM kw JOIN rd USING (document_id) WHERE rank <= 5"""


def unified_index(spark, sf_dir):
    """Narrative and table rows in one index."""
    return fx.retrieval_documents(spark, sf_dir).select("document_id", "source_id", "content_type", "report_id", "ticker", "report_year", "page_start", "page_end", "section_title", F.sha2("text", 256).alias("text_sha256"))


UNIFIED_SQL = f"WITH {fx.SQL['rd']} SELECT document_id, source_id, content_type, report_id, ticker, report_year, page_start, page_end, section_title, sha256(text) AS text_sha256 FROM rd"


def corpus_stats(spark, sf_dir):
    """Counts in one pass, missing embeddings included."""
    return _docs(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("ticker").alias("companies"), F.countDistinct("report_year").alias("years"),
        F.count_if(F.col("content_type") == "table").alias("tables"), F.count_if(F.col("content_type") == "narrative").alias("narratives"), F.count_if(F.col("embedding").isNull()).alias("without_embedding"),
    )


STATS_SQL = f"""WITH {fx.SQL['rd']} SELECT count(*) AS documents, count(DISTINCT ticker) AS companies, count(DISTINCT report_year) AS years, count(*) FILTER (content_type = 'table') AS tables,
  count(*) FILTER (content_type = 'narrative') AS narratives, count(*) FILTER (e.embedding IS NULL) AS without_embedding FROM rd LEFT JOIN embeddings e ON rd.document_id = 'narrative:' || e.vec_id"""


def counts_by_type(spark, sf_dir):
    """Documents by content type."""
    return fx.retrieval_documents(spark, sf_dir).groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


def counts_by_report(spark, sf_dir):
    """Candidates by ticker and year."""
    d = fx.retrieval_documents(spark, sf_dir).where((F.length("text") >= 120) & F.col("ticker").isNotNull() & F.col("report_year").isNotNull())
    return d.groupBy("ticker", "report_year").agg(F.count(F.lit(1)).alias("n"))


def filter_values(spark, sf_dir):
    """Sorted tickers and years."""
    return fx.retrieval_documents(spark, sf_dir).agg(F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"), F.array_join(F.sort_array(F.collect_set("report_year")).cast("array<string>"), ",").alias("years"))


def point_lookup(spark, sf_dir):
    """One table row by its id."""
    return fx.tables(spark, sf_dir).where(F.col("document_id") == "table:7").select("document_id", "text")


def token_histogram(spark, sf_dir):
    """X1 (simple analyzer): occurrences and documents of each lexeme."""
    t = fx.narratives(spark, sf_dir).select("document_id", F.explode(simple_tokens(F.col("text"))).alias("token"))
    per = t.groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


HISTOGRAM_SQL = r"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents WHERE text <> '')
SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM t WHERE token <> '' GROUP BY token"""


def dedup_chunks(spark, sf_dir):
    """First of each report and normal form, renumbered."""
    d = fx.narratives(spark, sf_dir).select("report_id", F.col("source_id").cast("long").alias("chunk_index"), "document_id", "text")
    return dedup.dedup_chunks(d).select("report_id", "document_id", F.col("chunk_index").cast("int").alias("chunk_index"))


_FORM = r"trim(regexp_replace(regexp_replace(lower(text), '[\s\x{a0}]+', ' ', 'g'), '[^\p{L}\p{N}_ ]', '', 'g'))"
DEDUP_SQL = f"""WITH {fx.SQL['rd']}, d AS (SELECT report_id, document_id, CAST(source_id AS BIGINT) AS i, {_FORM} AS f FROM rd WHERE content_type = 'narrative'),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY report_id, f ORDER BY i) = 1)
SELECT report_id, document_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY i) AS INTEGER) AS chunk_index FROM k"""


def dedup_exact(spark, sf_dir):
    """First of each report and text digest."""
    d = fx.narratives(spark, sf_dir).withColumn("n", F.col("source_id").cast("long"))
    return dedup.dedup_exact(d, ["n"]).select("report_id", "document_id")


EXACT_SQL = f"WITH {fx.SQL['rd']} SELECT report_id, document_id FROM rd WHERE content_type = 'narrative' QUALIFY row_number() OVER (PARTITION BY report_id, sha256(text) ORDER BY CAST(source_id AS BIGINT)) = 1"


def word_slices(spark, sf_dir):
    """slices of 400 words with their digests."""
    return slices(fx.narratives(spark, sf_dir)).select("document_id", "slice", F.sha2("text", 256).alias("text_sha256"))


SLICES_SQL = r"""WITH w AS (SELECT 'narrative:' || doc_id AS document_id, list_filter(string_split_regex(text, '[\s\x{a0}]+'), lambda x: x <> '') AS w FROM documents WHERE text <> '')
SELECT document_id, CAST(i AS INTEGER) AS slice, sha256(array_to_string(w[i * 400 + 1 : i * 400 + 400], ' ')) AS text_sha256 FROM (SELECT *, unnest(range(0, (len(w) + 399) // 400)) AS i FROM w)"""


def result_display(spark, sf_dir):
    """Hybrid results as the table that a user sees."""
    out = search.hybrid_search(_docs(spark, sf_dir), QUERY, query_vector(spark, sf_dir), 15, analyzer="simple")
    score = F.coalesce("rrf_score", "score")
    label = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" "), F.col("ticker"), F.lit(" · "), F.col("report_year").cast("string"))
    return out.where(score.isNotNull()).select("rank", score.alias("score"), label.alias("label"), page_label(F.col("page_start"), F.col("page_end")).alias("pages"))


DISPLAY_SQL = HYBRID_SQL.partition("\nSELECT document_id")[0] + """
SELECT CAST(rank AS INTEGER) AS rank, rrf_score AS score, '#' || rank || ' ' || ticker || ' · ' || report_year AS label, CAST(page_start AS VARCHAR) AS pages FROM r JOIN rd USING (document_id) WHERE rank <= 15"""

#: Forms of the stems that the English queries ask for; the test prose has no others.
_STEMS = {"er": "er eres ered ering", "tion": "tion tiones tioned tioning", "ed": "ed edes eded eding"}
_STEMMED = r"""tok AS (
  SELECT document_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM rd),
all_tokens AS (SELECT document_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM tok),""" + f"""
lex AS (SELECT document_id, pos, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS dense, CASE {' '.join(f"WHEN t IN ({', '.join(repr(x) for x in forms.split())}) THEN '{stem}'" for stem, forms in _STEMS.items())} END AS t
  FROM all_tokens WHERE t NOT IN ({', '.join(repr(w) for w in sorted(STOP_WORDS))})),
occ AS (SELECT *, lag(t) OVER (PARTITION BY document_id ORDER BY pos) AS pt, lag(pos) OVER (PARTITION BY document_id ORDER BY pos) AS pp, lag(dense) OVER (PARTITION BY document_id ORDER BY pos) AS pd FROM lex WHERE t IN ('er', 'tion')),
cover AS (SELECT document_id, count(DISTINCT t) AS n, bool_or(t = 'er') AS er, bool_or(t = 'tion') AS tion, coalesce(bool_or(pt = 'er' AND t = 'tion' AND dense = pd + 1), false) AS phrase, round(sum(CASE WHEN pt <> t THEN 0.1::DOUBLE / (pos - pp) ELSE 0 END), 9) AS score FROM occ GROUP BY 1),
hit AS (SELECT document_id, score, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM cover WHERE {{}})"""


def _english_sql(where: str) -> str:
    return f"WITH {fx.SQL['rd']}, {_STEMMED.replace('{}', where)} SELECT {_SHORT} FROM hit JOIN rd USING (document_id) WHERE rank <= 10"


def keyword_search_english(spark, sf_dir):
    """Stems and stop words, over the texts."""
    return search.keyword_search(fx.retrieval_documents(spark, sf_dir), "the ering tioned", 10).select(*SHORT)


def _index(spark, sf_dir, analyzer):
    e = fx.read(spark, sf_dir, "embeddings").select(F.concat(F.lit("narrative:"), F.col("vec_id").cast("string")).alias("document_id"), "embedding")
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/index-{uuid.uuid4().hex}"
    counts = index.build_index(fx.narratives(spark, sf_dir), fx.tables(spark, sf_dir), e, path, analyzer=analyzer)
    return counts, index.load_index(spark, path, analyzer)


def index_build(spark, sf_dir):
    """Documents and postings written, read back and counted."""
    counts, _ = _index(spark, sf_dir, "simple")
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


BUILD_SQL = f"""WITH {fx.SQL['rd']}, {_POST} SELECT count(*) FILTER (content_type = 'narrative') AS narratives, count(*) FILTER (content_type = 'table') AS tables, count(*) AS documents, count(DISTINCT document_id) AS ids,
  count(e.embedding) AS embeddings, (SELECT count(*) FROM (SELECT DISTINCT document_id, t FROM post)) AS postings FROM rd LEFT JOIN embeddings e ON rd.document_id = 'narrative:' || e.vec_id"""


def index_search(spark, sf_dir):
    """R1, X1 from the built index: two stems joined by AND."""
    return index.search_index(_index(spark, sf_dir, "english")[1], "the ering tioned", 10).select(*SHORT)


def index_search_phrase(spark, sf_dir):
    """X1, P2 from the built index: a phrase, with a stop word between that does not count."""
    return index.search_index(_index(spark, sf_dir, "english")[1], '"ered the tion"', 10).select(*SHORT)


def index_search_or_minus(spark, sf_dir):
    """X1, P2 from the built index: OR of a word and of a word without another."""
    return index.search_index(_index(spark, sf_dir, "english")[1], "er or tiones -eding", 10).select(*SHORT)


QUERIES = {
    "keyword_search_english": (keyword_search_english, _english_sql("n = 2")),
    "index_build": (index_build, BUILD_SQL),
    "index_search": (index_search, _english_sql("n = 2")),
    "index_search_phrase": (index_search_phrase, _english_sql("phrase")),
    "index_search_or_minus": (index_search_or_minus, _english_sql("er OR (tion AND document_id NOT IN (SELECT document_id FROM lex WHERE t = 'ed'))")),
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "keyword_search": (keyword_search, KEYWORD_SQL),
    "keyword_search_filtered": (keyword_search_filtered, KEYWORD_FILTERED_SQL),
    "vector_search": (vector_search, VECTOR_SQL),
    "vector_search_filtered": (vector_search_filtered, VECTOR_FILTERED_SQL),
    "context_block": (context_block, CONTEXT_SQL),
    "result_display": (result_display, DISPLAY_SQL),
    "unified_index": (unified_index, UNIFIED_SQL),
    "corpus_stats": (corpus_stats, STATS_SQL),
    "counts_by_type": (counts_by_type, f"WITH {fx.SQL['rd']} SELECT content_type, count(*) AS n FROM rd GROUP BY 1"),
    "counts_by_report": (counts_by_report, f"WITH {fx.SQL['rd']} SELECT ticker, report_year, count(*) AS n FROM rd WHERE length(text) >= 120 AND ticker IS NOT NULL GROUP BY 1, 2"),
    "filter_values": (filter_values, f"WITH {fx.SQL['rd']} SELECT string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers, (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT CAST(report_year AS VARCHAR) AS y FROM rd)) AS years FROM rd"),
    "point_lookup": (point_lookup, f"WITH {fx.SQL['rd']} SELECT document_id, text FROM rd WHERE document_id = 'table:7'"),
    "token_histogram": (token_histogram, HISTOGRAM_SQL),
    "dedup_chunks": (dedup_chunks, DEDUP_SQL),
    "dedup_exact": (dedup_exact, EXACT_SQL),
    "word_slices": (word_slices, SLICES_SQL),
}
