"""Benchmark decontamination: prefix-filtered exact containment of benchmark windows.

Method. Each benchmark item is cut into windows of ``size`` consecutive words
(an item with fewer is one window). The words of a window are ordered by their
rarity in the corpus; for containment of the whole window the necessary prefix
is its rarest word alone. The corpus' words are joined with these prefix words.
A candidate survives the length and positional bounds (the window placed at the
word's offset must lie inside the document) and then the exact comparison of the
item-sized window. Only DataFrame functions are used.

The window table is broadcast while it has at most ``BROADCAST_BYTES`` bytes;
then a document's word array travels by reference within its row until the window
is verified. Beyond that the join is shuffled on the prefix word, sending only
positions, and what passes the bounds is joined with the word arrays by document.

Edge cases: null and empty texts have no words (n_words 0, not contaminated);
items without words have no window; repeated items count under each item_id;
an item with a null item_id is ignored, or with ``null_items`` counts as any other,
with a null at the end of the items; rows that repeat a document's id and text give one
row each; null document ids are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, fits, read_table, written

WINDOW, BROADCAST_BYTES = 13, 32 << 20
#: ASCII characters that end a word, after A-Z are lower-cased.
_BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def word_array(text) -> object:
    """Lower-case (A-Z) words of ASCII digits, ASCII letters and all characters above ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + _BREAKS, UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " ", -1), "")


def _windows(items: DataFrame, size: int, null_items: bool) -> DataFrame:
    """(words, items): distinct windows, each with the ids of the items that have it."""
    w = items.select("item_id", word_array(F.col("text")).alias("w")).where("size(w) > 0" if null_items else "item_id is not null and size(w) > 0")
    at = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))).alias("i"))
    return at.select("item_id", F.slice("w", F.col("i"), size).alias("words")).groupBy("words").agg(F.flatten(F.collect_set(F.array(F.col("item_id").cast("string")))).alias("items"))


def _prefixed(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the rarest word of each window (frequency over all documents, ties to the first) and its offset."""
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    small = fits(vocabulary, BROADCAST_BYTES, "48 + octet_length(word)")
    if small:
        vocabulary = F.broadcast(vocabulary)
    seen = docs.select(F.explode(word_array(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").count()
    if small:  # a word that most windows have would lie in one task otherwise
        seen = F.broadcast(seen)
    places = windows.select("words", F.posexplode("words").alias("offset", "word"))
    ranked = places.join(seen, "word", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "offset", "word")).alias("p"))
    return windows.join(ranked, "words").select("words", "items", F.col("p.word").alias("word"), F.col("p.offset").alias("offset"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = WINDOW, null_items: bool = False) -> DataFrame:
    """(id, n_words, n_hit, items) per document row; ``items``: sorted ids of items with a window in the text."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    windows = _prefixed(_windows(items.select("item_id", "text"), size, null_items), d)
    windows, _ = written(windows.select("words", "items", "word", "offset", F.size("words").alias("n")), "windows")
    own = d.select("id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("fp"), word_array(F.col("text")).alias("w"))
    # the empty word at the end meets a window of its own, so that every row gives a row
    end = docs.sparkSession.range(1).select(
        F.array().cast(T.ArrayType(T.StringType())).alias("words"), F.array().cast(T.ArrayType(T.StringType())).alias("items"),
        F.lit("").alias("word"), F.lit(0).alias("offset"), F.lit(0).alias("n"),
    )
    inside = "n = 0 or (start >= 0 and start + n <= n_words)"
    equal = F.expr("n = 0 or slice(w, greatest(start, 0) + 1, greatest(n, 1)) = words")
    words = own.select("id", "fp", "w", F.size("w").alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    start = (F.col("pos") - F.col("offset")).alias("start")
    if fits(windows, BROADCAST_BYTES, "96 + octet_length(array_join(words, ' ')) + 24 * n + octet_length(array_join(items, ' ')) + 24 * size(items)"):
        hits = words.join(F.broadcast(windows.unionByName(end)), "word").select("*", start).where(inside).where(equal)
    else:
        near = words.drop("w").join(windows.unionByName(end), "word").select("id", "fp", "n_words", "words", "items", "n", start).where(inside)
        once = own.dropDuplicates(["id", "fp"]).withColumnsRenamed({"id": "id_", "fp": "fp_"})
        hits = near.join(once, F.col("id").eqNullSafe(F.col("id_")) & (F.col("fp") == F.col("fp_"))).where(equal)
    hits = hits.select("id", "fp", F.col("n_words").cast("long").alias("n_words"), "start", "n", "items")
    spans = hits.groupBy("id", "fp", "n_words", "start", "n").agg(F.count(F.lit(1)).alias("copies"), F.first("items").alias("items"))
    so_far = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("id", "fp", "n_words").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(so_far, F.lit(0)))))
    per = new.groupBy("id", "fp", "n_words").agg(
        F.sum(F.when(F.col("n") > 0, F.col("new")).otherwise(0)).alias("n_hit"),
        F.max(F.when(F.col("n") == 0, F.col("copies"))).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("id", "n_words", "n_hit", "items")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, and whether they cover a twentieth of it."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), null_items=True)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, w[i : least(i + 12, len(w))] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT len(win) AS n FROM bw
), dw AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
