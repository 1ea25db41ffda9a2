"""Exact top-k inner products by block-at-a-time pruning.

Method. A component of a vector is a term, its value the term's weight. Rows are
ordered by their two heaviest terms, so that a range of rows shares terms, and
ranges of ``block`` rows are stored as blocks: a forward index of the rows and the
greatest and least weight of each term in the block. The bound of a query on a
block is the sum over its terms of weight times the block's maximum (its minimum
where the query's weight is negative). Each query takes blocks in falling order of
the bound, scores all rows of a block through the forward index, and stops where the
bound falls below its k-th score (``cells.py``).

The result is exact at any bounds. Where rows share no terms the bounds rule
nothing out, and every pair is scored once.

Edge cases: vectors that are null or hold null or non-finite components, and rows
with a null id, take no part; rows of a query's own id are not its candidates;
repeated rows are rows of their own, as candidates and as queries; ties go by
smaller id; only vectors of one length meet, those of no component score 0; fewer
than k candidates give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import BLOCK, asked, matrix, scaled_rows, search, stored_blocks
from .common import read_table

K, SCALE = 5, 256


def term_bounds(x: np.ndarray, blocks: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the terms' maxima and minima in each block, by the sign of the query's weights."""
    lows, highs = matrix(blocks["lows"], dim), matrix(blocks["highs"], dim)
    plus, minus = np.maximum(x, 0), np.minimum(x, 0)
    return plus @ highs.T + minus @ lows.T, plus @ lows.T + minus @ highs.T


def top_k(
    vectors: DataFrame, which: str, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, scale: int = SCALE, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of greatest inner product with each row for which the SQL condition ``which`` on ``id`` holds."""
    rows = scaled_rows(vectors, id_col, vector_col, None, scale)
    sizes = F.transform("v", lambda c, i: F.struct((-F.abs(c)).alias("w"), i.alias("i"), (c < 0).alias("s")))
    heavy = F.slice(F.array_sort(sizes), 1, 2)
    term = lambda n: F.coalesce(2 * F.get(heavy, F.lit(n))["i"] + F.get(heavy, F.lit(n))["s"].cast("int"), F.lit(-1))
    keyed = rows.select("*", F.lit(0).alias("part"), F.lit(0.0).alias("key"), term(0).alias("t0"), term(1).alias("t1"))
    blocks, _ = stored_blocks(keyed, ["dim", "t0", "t1", "id"], block)
    queries, _ = asked(rows, which)
    found = search(blocks, queries, term_bounds, k)
    return found.join(queries.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "id", "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of greatest inner product with every fiftieth embedding."""
    found = top_k(read_table(spark, sf_dir, "embeddings"), "id % 50 = 0")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
