"""Importance resampling towards a target: n-gram log-ratio weights and a Gumbel top draw.

Method. The distinct words of a run of documents get integer ids, and n-grams are
tuples of these ids: a pair is one integer (first id, second id), a triple one
integer (number of its pair, third id). Each distinct tuple of the run is hashed
once, the checksum of its bytes being carried on from that of the shorter tuple, and
the hash goes back to all its occurrences through the inverse of the distinct step,
and so to the counts. The dictionary belongs to the run (about ``RUN_BYTES`` of text,
one document at least), not to the corpus: an id of the whole corpus would cost a
shuffle of every occurrence of every word and n-gram, while the table of hashes costs
none. What crosses the network is one count a bucket and task.

The buckets of all occurrences are written once beside the row's facts, counted, and
read again for the sums of gains. The draw is a global order: rows are dealt by
ranges of (score, id), each range is numbered where it lies, and the sizes of the
ranges, one number a partition, give the offset of each.

Edge cases: a null or empty text, or one without words, has no features and weight 0;
repeated rows are documents of their own; a null id has no score and is drawn never,
but its text counts in the corpus and in the number of documents; equal scores go by id;
an empty target or an empty corpus gives counts of 0, which the gains allow for; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, partitions, read_table, written

BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 42, 0.05, 20
#: Text of a run of documents that share a word dictionary.
RUN_BYTES = 4 << 20

_WORD = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
#: Every byte that ends a word as a space, A-Z in lower case.
_TABLE = bytes(b if b in _WORD else 32 for b in (bytes([c]).lower()[0] for c in range(256)))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case (A-Z) words of ASCII digits, ASCII letters and bytes above ASCII."""
    return text.translate(_TABLE).split()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True) if len(keys) else (keys, keys)


def run_buckets(texts: list[bytes], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three words: (buckets of all occurrences in order, number in each text)."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    split = [words_of(t) for t in texts]
    size = np.array([len(s) for s in split], np.int64)
    at = np.fromiter((ids[w] for s in split for w in s), np.int64, size.sum())
    owner = np.repeat(np.arange(len(texts)), size)
    spaced, n = [b" " + w for w in ids], max(len(ids), 1)
    one = [crc32(w) for w in ids]
    # a pair begins at each word but a text's last, a triple at each but its last two
    pair_at = np.flatnonzero(owner[:-1] == owner[1:])
    pairs, pair = _distinct(at[pair_at] * n + at[pair_at + 1])
    two = [crc32(spaced[b], one[a]) for a, b in zip((pairs // n).tolist(), (pairs % n).tolist())]
    triple_from = np.flatnonzero(owner[pair_at[:-1]] == owner[pair_at[1:]])
    triples, triple = _distinct(pair[triple_from] * n + at[pair_at[triple_from] + 2])
    three = [crc32(spaced[c], two[p]) for p, c in zip((triples // n).tolist(), (triples % n).tolist())]
    hashed = lambda sums: (np.array(sums, np.int64) % buckets).astype(np.int32)
    return [
        (hashed(one)[at], size),
        (hashed(two)[pair], np.maximum(size - 1, 0)),
        (hashed(three)[triple], np.maximum(size - 2, 0)),
    ]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, pa.int32()))


def _features(buckets: int):
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + RUN_BYTES, "right")))
                found = run_buckets(texts[start:end], buckets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, end - start), pa.array(found[0][1]), *(_lists(*f) for f in found)], ["id", "n_words", "b1", "b2", "b3"]
                )
                start = end

    return run


def _counts(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for name in ("b1", "b2", "b3"):
                total += np.bincount(batch.column(name).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "n"])

    return run


def _weights(gains: np.ndarray):
    def run(batches):
        for batch in batches:
            weight, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for name in ("b1", "b2", "b3"):
                lists = batch.column(name)
                at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                upto = np.concatenate(([0], np.cumsum(gains[lists.flatten().to_numpy(zero_copy_only=False)])))
                weight += upto[at[1:]] - upto[at[:-1]]
                n += np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return run


def _bucketed(texts: DataFrame, buckets: int, kind: str, name: str) -> tuple[DataFrame, str]:
    return written(map_arrow(texts, _features(buckets), f"id {kind}, n_words long, b1 array<int>, b2 array<int>, b3 array<int>"), name)


def _total(features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket; at most ``buckets`` numbers come to the driver."""
    rows = map_arrow(features.select("b1", "b2", "b3"), _counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    k, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = ((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k)) for a, b in zip(corpus, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _numbered(batches):
    """Adds the partition and the place in it."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], [*batch.schema.names, "part", "place"])
        seen += n


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *,
    buckets: int = BUCKETS, seed: int = SEED, share: float = SHARE, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for every document; ``rank`` from 1 for what is drawn, null for the rest.

    A ``share`` of the documents with at least ``least_words`` words is drawn without
    replacement, with probabilities that follow exp(weight / 1000).
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    features, features_path = _bucketed(own, buckets, kind, "features")
    goal, goal_path = _bucketed(target.select(F.lit(None).cast("long").alias("id"), F.col(target_col).alias("text")), buckets, "long", "target")
    gains = gains_of(_total(features, buckets), _total(goal, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    weighted = map_arrow(features, _weights(gains), f"id {kind}, n_words long, n_features long, weight long")
    scored = weighted.withColumn("score", F.col("weight") + noise).withColumn("out", F.col("score").isNull() | (F.col("n_words") < least_words))
    scored, scored_path = written(scored, "scored")
    order = ["out", F.desc("score"), "id", "n_features", "n_words"]
    ordered = scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed, _ = written(map_arrow(ordered, _numbered, ", ".join(f"{c} {t}" for c, t in scored.dtypes) + ", part int, place long"), "placed")
    facts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_words") >= least_words).alias("m")).orderBy("part").collect()
    starts = list(zip((r.part for r in facts), np.cumsum([0, *(r.n for r in facts)]).tolist()))
    drawn = math.floor(share * 1_000_000 + 0.5) * sum(r.m for r in facts) // 1_000_000
    for path in (features_path, goal_path, scored_path):
        forget(spark, path)
    rank = F.col("start") + F.col("place") + 1
    # a row a partition
    placed = placed.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part", "left")
    return placed.select("id", "n_words", "n_features", "weight", "score", F.when(~F.col("out") & (rank <= drawn), rank).cast("long").alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(rank, weight, row) of the drawn documents in no order: what a training job reads.

    ``row`` is the whole row of ``docs``. Rows that repeat an id come back with the
    smallest rank of the id, all of them if any is drawn.
    """
    found = importance_resample(docs, target, id_col, text_col, **options).where("rank is not null")
    best = found.groupBy("id").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    rows = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row"))
    return rows.join(best, "id").select("rank", "weight", "row")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the documents, drawn towards the benchmark's n-grams; every document's weight, score and rank."""
    found = importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), f AS (
  SELECT side, id, unnest(w) AS g FROM w
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM w)
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT side, id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), c AS (
  SELECT side, id, g, count(*) AS n FROM f GROUP BY ALL
), h AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM c)
), bytes AS (
  SELECT g, list_transform(range(1, length(x), 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1) AS b FROM h
), bucket AS (
  SELECT g, xor(list_reduce(list_concat([4294967295], b), lambda a, z: xor(a >> 8, t[(xor(a, z) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, tab
), k AS (
  SELECT side, id, k, sum(n) AS n FROM c JOIN bucket USING (g) GROUP BY ALL
), total AS (
  SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM k
), gain AS (
  SELECT k, floor(1000 * ln((b + 1) * (s + 10000) / ((d + 1) * (t + 10000))))::BIGINT AS gain
  FROM (SELECT k, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS d, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS b FROM k GROUP BY k), total
), weight AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM k JOIN gain USING (k) WHERE side = 'd' GROUP BY id
), h8 AS (
  SELECT doc_id, sha256('42:' || doc_id) AS x, len(w.w) AS n_words FROM documents d JOIN (SELECT id, any_value(w) AS w FROM w WHERE side = 'd' GROUP BY id) w ON w.id = d.doc_id
), scored AS (
  SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', x[i]) - 1), lambda a, z: a * 16 + z) + 0.5) / 4294967296)))::BIGINT AS score
  FROM h8 LEFT JOIN weight ON weight.id = doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM placed
"""
