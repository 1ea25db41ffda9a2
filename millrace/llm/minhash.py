"""MinHash near-duplicates: one-permutation hashing, optimal densification, star edges.

Method. A document's distinct word shingles are hashed once to 64 bits. The top
bits deal them over ``bands * rows`` bins and each bin keeps its smallest hash
(one permutation instead of hundreds). An empty bin borrows from the first
filled bin in a fixed random order of its own (optimal densification), so bins
of two sketches agree with the probability of the Jaccard similarity also for
short texts. Bands of bins are bucket keys. Documents with equal sets are one
node from the start; within a bucket nodes are tied to one head at a time
(``components.link_buckets``), and every tie is confirmed on the full sets.

With 64 bands of 8 rows a pair of similarity 0.8 shares no bucket with
probability 8e-6, and a pair of similarity 0.3 shares one with probability 0.004.

Edge cases: null and empty texts and texts of white space have no shingles and
are linked with nothing (n_shingles 0, own component, kept); rows with a null id
come back with null component_id and kept = true; repeated rows of one id give
one row each, with equal texts as one document, with unequal texts as documents
of the same id; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, read_table, ship, written
from .components import link_buckets

BANDS, ROWS = 64, 8
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to 64-bit hash; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingle_hashes(text: str | None, size: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, the whole sequence is one."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(parts) - size + 1)
    out = np.full(n, len(parts) if len(parts) < size else size, np.uint64)
    for k in range(min(size, len(parts))):
        out = _mix(out * _M3 + h[k : k + n])
    return np.unique(out)


@functools.lru_cache(4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin a random order of all bins: as places[t, bin] = t-th choice, and as ranks[bin, choice]."""
    rng = np.random.default_rng(20_240_517)
    ranks = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)
    return np.ascontiguousarray(np.argsort(ranks, axis=1).astype(np.int32).T), ranks


def sketch(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys of a set given as sorted distinct hashes (not empty)."""
    bins = bands * rows
    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    filled = at[first]
    values = np.zeros(bins, np.uint64)
    values[filled] = hashes[first]
    have = np.zeros(bins, bool)
    have[filled] = True
    empty = np.flatnonzero(~have)
    if len(empty):
        places, ranks = _orders(bins)
        if len(filled) < 64:
            values[empty] = values[filled[np.argmin(ranks[np.ix_(empty, filled)], axis=1)]]
        else:
            left = empty
            for t in range(bins):
                donor = places[t, left]
                ok = have[donor]
                values[left[ok]] = values[donor[ok]]
                left = left[~ok]
                if not len(left):
                    break
    grid = values.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = _mix(key * _M3 + grid[:, r])
    return key


def _sketches(size: int, bands: int, rows: int):
    def run(batches):
        words = _Words()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, fp, keys = [], [], []
            for text in texts:
                h = shingle_hashes(text.as_py(), size, words)
                n.append(len(h))
                fp.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                keys.append(sketch(h, bands, rows).view(np.int64) if len(h) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "fp", "keys"])

    return run


def _sets(size: int):
    def run(batches):
        words = _Words()
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), size, words) for t in batch.column(1)]
            # of several texts under one id, the one that the node stands for
            own = [k for k, (h, fp) in enumerate(zip(sets, batch.column(2).to_pylist())) if xxhash.xxh3_128_digest(h.tobytes()) == fp]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array([sets[k].view(np.int64) for k in own], pa.list_(pa.int64()))], ["node", "shingles"])

    return run


#: Set elements that one task of ``_settle`` holds of each of two blocks of a bucket.
BLOCK = 2_000_000


def _across(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between members of different components, one for each member and other component."""
        table = table.combine_chunks()
        sets = table["shingles"].chunk(0)
        nodes, comps = table["node"].to_pylist(), np.unique(table["component"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        starts = sets.offsets.to_numpy()[:-1] - sets.offsets.to_numpy()[0]
        sizes = np.diff(sets.offsets.to_numpy())
        values, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        major = np.bincount(comps).argmax()
        mask, a, b = np.zeros(len(values), np.uint8), [], []
        for i in np.flatnonzero(comps != major):
            own = codes[starts[i] : starts[i] + sizes[i]]
            mask[own] = 1
            both = np.add.reduceat(mask[codes], starts, dtype=np.int64)
            mask[own] = 0
            ok = ((100 + percent) * both >= percent * (sizes + sizes[i])) & (comps != comps[i])
            _, one = np.unique(comps[ok], return_index=True)
            for j in np.flatnonzero(ok)[one]:
                a.append(nodes[i])
                b.append(nodes[j])
        kind = table.schema.field("node").type
        return pa.table([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return run


def _settle(live: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links across components within buckets; a bucket goes in blocks, each pair of blocks to one task."""
    kind = live.schema["node"].dataType.simpleString()
    ship(live.sparkSession)
    # the tag is the size of the set; most buckets are one block
    blocks = live.groupBy("key").agg(F.ceil(F.sum("tag") / BLOCK).cast("int").alias("g")).where("g > 1")
    dealt = live.join(blocks, "key", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = dealt.select("key", "node", "component", "i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    dealt = dealt.select("key", F.least("i", "o").alias("lo"), F.greatest("i", "o").alias("hi"), "node", "component")
    return dealt.join(full, "node").groupBy("key", "lo", "hi").applyInArrow(_across(percent), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when 100 * |A and B| >= percent * |A or B|; a component
    is a connected group of links. Ids must be integers or strings.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    seen, seen_path = written(map_arrow(rows_in, _sketches(shingle, bands, rows), f"id {kind}, n_shingles long, fp binary, keys array<long>"), "sketches")
    # equal sets are one node with a number of its own, as an id can have several sets
    nodes = seen.where("fp is not null and id is not null").groupBy("fp").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id())
    nodes, nodes_path = written(nodes, "nodes")
    buckets = (
        nodes.join(seen.select("id", "fp", "keys", "n_shingles"), ["id", "fp"])
        .dropDuplicates(["id", "fp"]).select("node", F.col("n_shingles").alias("tag"), F.explode("keys").alias("key"))
    )
    buckets, buckets_path = written(buckets, "bands")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets, shared_path = written(buckets.join(shared, "key", "left_semi"), "shared-bands")
    forget(spark, buckets_path)
    # the full sets of those nodes that share a bucket with another
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    full, full_path = written(
        map_arrow(rows_in.join(wanted, "id").select("node", "text", "fp"), _sets(shingle), "node long, shingles array<long>").dropDuplicates(["node"]),
        "sets",
    )

    def confirm(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        fits = f"100 * least(ta, tb) >= {percent} * greatest(ta, tb)"
        # |A or B| = |A| + |B| - |A and B|
        return (
            pairs.where(fits).join(left, "a").join(right, "b")
            .withColumn("both", F.size(F.array_intersect("sa", "sb")))
            .where(f"{100 + percent} * cast(both as long) >= {percent} * (cast(size(sa) as long) + size(sb))")
            .select("a", "b")
        )

    found = link_buckets(buckets, confirm, lambda live: _settle(live, full, percent))
    forget(spark, full_path)
    forget(spark, shared_path)
    linked = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select("fp", "id", "component")
    named = linked.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    groups = linked.join(named, "component", "left").select("fp", F.coalesce("least", "id").alias("component"))
    # rows without a set have nothing to be joined with, and would all lie in one task
    found = seen.where("fp is not null").select("id", "n_shingles", "fp").join(groups, "fp", "left").select("id", "n_shingles", "component")
    found = found.unionByName(seen.where("fp is null").select("id", "n_shingles", F.lit(None).cast(kind).alias("component")))
    return found.select(
        "id", "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles have similarity 0.8 or more."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2).withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, after equal sets are merged; components by recursion over links.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS sh FROM d
), cls AS (
  SELECT sh, min(doc_id) AS node, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh
), post AS (
  SELECT node, n, unnest(sh) AS g FROM cls
), inter AS (
  SELECT x.node AS a, y.node AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
  FROM post x JOIN post y ON x.g = y.g AND x.node < y.node AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2
), e AS (
  SELECT a, b FROM inter WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM inter WHERE 100 * c >= 80 * (na + nb - c)
), reach AS (
  SELECT DISTINCT a AS node, a AS r FROM e
  UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.node WHERE reach.r < e.b
), comp AS (
  SELECT node, min(r) AS c FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(least(comp.c, cls.node), cls.node, s.doc_id) AS component_id,
  coalesce(least(comp.c, cls.node), cls.node, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN cls ON s.sh = cls.sh LEFT JOIN comp ON comp.node = cls.node
"""
