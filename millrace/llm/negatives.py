"""Hard negatives for contrastive training, by one-dimensional distance keys.

Method. With one more component, sqrt(M - |x|^2) where M is the greatest squared
length, all rows lie on a sphere and the squared distance of a query (its own extra
component 0) to a row is |q|^2 + M - 2 * score: nearest is best. Rows are stored
sorted by (pivot, distance to the pivot), the pivot being the nearest of a few
centroids, and cut into key intervals. A query at distance D from a pivot can have
neighbours within r only at keys from D - r to D + r, so it scans the intervals
of all pivots outward, in the order of the least distance they allow, and stops where
that distance exceeds its k-th (``cells.py``). The window of scores that a negative
may have is an annulus: intervals wholly inside its inner radius are skipped as well.

Positives are the best rows of the anchor's label. Negatives are asked for each anchor
and positive: the best rows of other labels whose score is from ``low`` to ``high``
hundredths of the positive's.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; rows of the anchor's id are neither its positives nor its
negatives; repeated rows are rows of their own; ties go by smaller id; a positive of
negative score has no negatives, one of score 0 only such of score 0; only vectors
of one length meet; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import BLOCK, Bounds, asked, matrix, scaled_rows, search, stored_blocks
from .common import map_arrow, read_table, written
from .vectors import kmeans

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Rows that pivots are fitted to, at most; fewest and most pivots.
SAMPLE, PIVOTS = 20_000, (4, 256)
SLACK = 1e-9


class Pivots:
    """Centroids of the augmented rows of one length; ``greatest`` is M."""

    def __init__(self, greatest: int, centres: np.ndarray):
        self.greatest, self.centres = greatest, centres

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(self.greatest - (x * x).sum(1), 0))))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and the distance to it."""
        far = self._distances(self.augmented(x))
        near = np.argmin(far, axis=1)
        return near.astype(np.int32), far[np.arange(len(x)), near]

    def query_distances(self, x: np.ndarray) -> np.ndarray:
        return self._distances(np.column_stack((x, np.zeros(len(x)))))

    def _distances(self, x: np.ndarray) -> np.ndarray:
        c = self.centres
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))


def _fitted(rows: DataFrame, sample: int, pivots: int | None) -> dict[int, Pivots]:
    """Pivots for each length; at most ``sample`` rows of a length, in the order of a hash, come to the driver."""
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    out = {}
    for r in rows.groupBy("dim").agg(F.max(square).alias("m"), F.count(F.lit(1)).alias("n")).collect():
        fit = rows.where(F.col("dim") == r.dim).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
        own = Pivots(r.m, np.empty((0, r.dim + 1)))
        x = own.augmented(matrix(fit["v"], r.dim))
        many = pivots or min(max(round(r.n**0.5 / 4), PIVOTS[0]), PIVOTS[1])
        out[r.dim] = Pivots(r.m, kmeans(x, min(many, len(x))))
    return out


def _keyed(models: dict[int, Pivots]):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                pivot, key = models[int(dim)].keys(matrix(part.column("v"), int(dim)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot), pa.array(key)], [*part.schema.names, "part", "key"])

    return run


def interval_bounds(models: dict[int, Pivots]) -> Bounds:
    """Scores at the least and greatest distance that a key interval allows; the slack is far above the rounding of the distances."""

    def bounds(x: np.ndarray, blocks: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
        model = models[dim]
        d = model.query_distances(x)[:, blocks["part"].to_numpy()]
        near, far = blocks["near"].to_numpy(), blocks["far"].to_numpy()
        least = np.maximum(np.maximum(d - far, near - d), 0)
        whole = (x * x).sum(1)[:, None] + model.greatest
        slack = SLACK * whole + 1
        return (whole - least**2) / 2 + slack, (whole - (d + far) ** 2) / 2 - slack

    return bounds


def hard_negatives(
    vectors: DataFrame, anchors: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, sample: int = SAMPLE, pivots: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are rows for which the SQL condition ``anchors`` on ``id`` holds."""
    rows, _ = written(scaled_rows(vectors, id_col, vector_col, label_col, scale), "scaled")
    models = _fitted(rows, sample, pivots)
    keyed = map_arrow(rows, _keyed(models), "id long, label string, dim int, v array<long>, part int, key double")
    blocks, _ = stored_blocks(keyed, ["dim", "part", "key", "id"], block)
    bounds = interval_bounds(models)
    queries, _ = asked(rows, anchors)
    best = search(blocks, queries, bounds, positives, same=True).where("score >= 0")
    wanted = best.select("q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(queries.drop("least", "most"), "q").drop("q")
    limits = {"least": F.expr(f"({low} * positive_score + 99) div 100"), "most": F.expr(f"({high} * positive_score) div 100")}
    wanted, _ = written(wanted.withColumns(limits).withColumn("q", F.monotonically_increasing_id()), "wanted")
    found = search(blocks, wanted.drop("positive_id", "positive_score"), bounds, negatives, same=False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    pairs = wanted.select("q", F.col("id").alias("anchor_id"), "positive_id", "positive_score")
    return found.join(pairs, "q").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth embedding; the label of every seventh is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", label), "id % 50 = 0")
    return found.withColumn("rank", F.col("rank").cast("int"))


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
