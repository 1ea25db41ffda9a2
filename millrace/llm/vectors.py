"""Embedding near-duplicates: inverted lists, product-quantised residuals, exact rerank.

Method. Equal vectors of a label are one point. A coarse k-means deals the unit
vectors over inverted lists; the residual to the list's centroid is stored as one
byte a subspace (product quantisation). A query visits lists and gets distances
to their codes by adding up table entries, keeps what the codes cannot rule out,
and computes the exact cosine (double precision) of the rest.

Both cuts are safe. A list is visited unless the query lies farther from the
bisecting hyperplane of the two centroids than the link distance
sqrt(2 - 2 * threshold), so no neighbour can be in it; a code is dropped only if
its distance less the length of its quantisation error exceeds the link
distance. Recall is therefore that of brute force, whatever the sample of at most
``sample`` vectors that centroids and codebooks are fitted to.

Every vector is indexed and every vector is a query. A list of a label goes in
blocks of about ``BLOCK`` vectors, and so do the queries that visit it; each pair of
blocks is a task's group of its own, so none grows with the data. The number of
lists follows the square root of the number of vectors.
A task returns the number of links of each query and, for connectivity, one edge
a vector to its local group, never the pairs.

Edge cases: vectors that are null, zero, or have null or non-finite components,
and rows with a null label, link with nothing; labels never mix; vectors of
different lengths never link; repeated rows are separate vectors with one id and
count as links of each other; null ids come back with null component and kept
true; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, read_table, ship, written
from .components import connected_components

THRESHOLD, SAMPLE, PARTS, BLOCK = 0.98, 20_000, 8, 4096
#: Fewest and most lists.
LISTS = (16, 1024)
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of ``x``; an empty cluster takes a random point."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        order = np.argsort(near, kind="stable")
        seen, first = np.unique(near[order], return_index=True)
        n = np.diff(np.append(first, len(x)))
        c[seen] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
        gone = np.setdiff1d(np.arange(len(c)), seen)
        c[gone] = x[rng.integers(0, len(x), len(gone))]
    return c


class Quantiser:
    """Centroids and codebooks for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS):
        self.centroids = kmeans(sample, min(lists, len(sample)))
        self.cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        rest = sample - self.centroids[self.assign(sample)]
        self.books = [kmeans(rest[:, a:b], min(256, len(rest)), seed=5 + a) for a, b in zip(self.cuts, self.cuts[1:])]

    def _distances(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self._distances(x), axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of the error each makes."""
        rest = x - self.centroids[cell]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for j, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            part, book = rest[:, a:b], self.books[j]
            codes[:, j] = np.argmin((book * book).sum(1) - 2 * part @ book.T, axis=1)
            error += ((part - book[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for every list that can hold a vector within ``reach`` of the row."""
        d, c = self._distances(x), self.centroids
        own = np.argmin(d, axis=1)
        apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 0))
        return np.nonzero(d - d[np.arange(len(x)), own][:, None] <= 2 * reach * apart[own] + SLACK)

    def table(self, x: np.ndarray, cell: int) -> np.ndarray:
        """[row, part, code] squared distances of the residuals of ``x`` to the codebook entries."""
        rest = x - self.centroids[cell]
        out = np.full((len(x), len(self.books), 256), np.inf)
        for j, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            part, book = rest[:, a:b], self.books[j]
            out[:, j, : len(book)] = (part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(model: Quantiser, dim: int, reach: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), dim)
            cell = model.assign(x)
            codes, error = model.encode(x, cell)
            row, probe = model.probes(x, reach)
            where = np.concatenate((np.arange(len(x)), row))
            n, q = len(x), len(row)
            pick = batch.select(["label", "point", "m", "v"]).take(pa.array(where))
            yield pa.RecordBatch.from_arrays(
                [*pick.columns, pa.array(np.concatenate((cell, probe)).astype(np.int32)), pa.array(np.repeat([False, True], [n, q])),
                 pa.array([c.tobytes() for c in codes] + [None] * q, pa.binary()), pa.array(np.concatenate((error, np.zeros(q))))],
                ["label", "point", "m", "v", "cell", "query", "codes", "error"],
            )

    return run


def _search(model: Quantiser, dim: int, threshold: float, reach: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of the queries with the block's vectors."""
        query = table["query"].to_numpy(zero_copy_only=False).astype(bool)
        lists, asks = table.filter(pa.array(~query)), table.filter(pa.array(query))
        if not lists.num_rows or not asks.num_rows:
            return pa.table({"point": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        cell = int(table["cell"][0].as_py())
        x, y = _matrix(asks["v"], dim), _matrix(lists["v"], dim)
        codes = np.frombuffer(b"".join(lists["codes"].to_pylist()), np.uint8).reshape(len(y), -1)
        px, py = asks["point"].to_numpy(), lists["point"].to_numpy()
        m, most = lists["m"].to_numpy(), (reach + lists["error"].to_numpy()) ** 2 + SLACK
        ids, at = np.unique(np.concatenate((px, py)), return_inverse=True)
        ax, ay = at[: len(px)], at[len(px) :]
        parent, count = np.arange(len(ids)), np.zeros(len(px), np.int64)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for lo in range(0, len(x), 64):
            part = x[lo : lo + 64]
            look = model.table(part, cell)
            d = sum(look[:, j, codes[:, j]] for j in range(codes.shape[1]))
            for i, near in enumerate(d <= most):
                near = np.flatnonzero(near)
                near = near[(y[near] @ part[i] >= threshold) & (py[near] != px[lo + i])]
                count[lo + i] = m[near].sum()
                if len(near):
                    roots = {root(k) for k in (ax[lo + i], *np.unique(parent[ay[near]]))}
                    least = min(roots)
                    for r in roots:
                        parent[r] = least
        top = np.array([ids[root(i)] for i in range(len(ids))])
        n = np.bincount(ax, weights=count, minlength=len(ids)).astype(np.int64)
        own = (n > 0) | (top != ids)
        return pa.table({"point": ids[own], "n": n[own], "root": top[own]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = THRESHOLD, sample: int = SAMPLE, lists: int | None = None, parts: int = PARTS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; ids must be integers."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = F.expr("label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    marked = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("fp", F.when(F.col("v").isNotNull(), F.struct("label", F.size("v").alias("dim"), F.xxhash64("v").alias("h0"), F.xxhash64(F.reverse("v")).alias("h1"))))
    points = marked.where("fp is not null and id is not null").groupBy("fp").agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    points, points_path = written(points, "points")
    edges = counts = None
    paths = []
    for dim, many in sorted(tuple(r) for r in points.groupBy("fp.dim").count().collect()):
        own = points.where(F.col("fp.dim") == dim).select("fp.label", "point", "m", "v")
        # a bounded sample in the order of a hash
        fit = own.select("point", "v").orderBy(F.xxhash64("point"), "point").limit(sample).toArrow()
        model = Quantiser(_matrix(fit["v"], dim), lists or min(max(round(many**0.5), LISTS[0]), LISTS[1]), parts)
        reach = float(np.sqrt(2 - 2 * threshold))
        kind = own.schema["label"].dataType.simpleString()
        index, path = written(map_arrow(own, _index(model, dim, reach), f"label {kind}, point long, m long, v array<double>, cell int, query boolean, codes binary, error double"), "index")
        paths.append(path)
        per = lambda side: F.greatest(F.lit(1), F.ceil(F.count_if(side) / BLOCK)).cast("int")
        sizes = index.groupBy("label", "cell").agg(per(~F.col("query")).alias("g"), per(F.col("query")).alias("h"))
        own_block = lambda n: F.array(F.pmod(F.xxhash64("point"), n).cast("int"))
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        dealt = index.join(sizes, ["label", "cell"])
        dealt = dealt.withColumn("i", F.explode(F.when(F.col("query"), every("g")).otherwise(own_block(F.col("g"))))).withColumn("o", F.explode(F.when(F.col("query"), own_block(F.col("h"))).otherwise(every("h")))).drop("g", "h")
        ship(spark)
        hits = dealt.groupBy("label", "cell", "i", "o").applyInArrow(_search(model, dim, threshold, reach), "point long, n long, root long")
        hits, path = written(hits, "hits")
        paths.append(path)
        edges = hits.select("point", "root") if edges is None else edges.unionByName(hits.select("point", "root"))
        counts = hits.select("point", "n") if counts is None else counts.unionByName(hits.select("point", "n"))
    if edges is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found, _ = written(connected_components(edges, "point", "root"), "vector-components")
    total, _ = written(counts.groupBy("point").agg(F.sum("n").alias("n")), "vector-links")
    for path in paths:
        forget(spark, path)
    facts = points.select("fp", "point", "m").join(found.withColumnRenamed("id", "point"), "point", "left").join(total, "point", "left").select(
        "fp", F.coalesce("component", "point").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")
    )
    out = marked.select("id", F.when(F.col("id").isNotNull(), F.col("fp")).alias("fp")).join(facts, "fp", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label with cosine 0.98 or more."""
    return near_vectors(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT a AS node, a AS r FROM l UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.node WHERE reach.r < l.b
), comp AS (
  SELECT node, min(r) AS c FROM reach GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(least(comp.c, vec_id), vec_id) AS component_id, coalesce(least(comp.c, vec_id), vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.node = vec_id
"""
