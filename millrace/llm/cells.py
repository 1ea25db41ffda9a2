"""Exact top-k of inner products for a stated query set: blocks of rows, groups of queries.

Rows are stored in blocks, cut from an order in which alike rows lie together.
Blocks are dealt to shards and queries to groups, both of bounded bytes, and every
pair of a group and a shard is one cell, a task's group of its own. In a cell each
query takes the blocks in the order of an upper bound on the scores in them and
stops where the bound falls below the k-th score that is known. What is known comes
from a first pass, in which each query scores its first blocks of each shard; its
k-th score there cannot exceed the one over all rows. Bounds only save work: the
result is that of scoring all pairs, ties by id included.

Scores are whole numbers, exact in doubles below 2^53; a component that could leave
that range is an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_arrow, ship, written

#: Rows of a block; vector components of a shard of blocks, and of a group of queries.
BLOCK, SHARD_VALUES, GROUP_VALUES = 256, 1 << 20, 1 << 16
#: Blocks that each query scores in each shard in the first pass.
FIRST_BLOCKS = 2
LAST_ID = np.iinfo(np.int64).max

#: upper and lower bounds on the scores of queries (rows) with the rows of blocks (columns); takes (queries, table of blocks, length).
Bounds = Callable[[np.ndarray, pa.Table, int], tuple[np.ndarray, np.ndarray]]


def scaled_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """(id, label, dim, v): floor(scale * x) of every component x as a double; rows without an id, or whose vector is null or holds a null or non-finite component, are left out."""
    label = F.lit("").alias("label") if label_col is None else F.col(label_col).cast("string").alias("label")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label, F.col(vector_col).cast("array<double>").alias("x"))
    sound = rows.where("id is not null and x is not null and label is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    most = F.sqrt(F.lit(2.0**53) / F.greatest(F.size("x"), F.lit(1)))
    wide = F.exists("x", lambda c: F.abs(scale * c) + 1 > most)
    v = F.when(wide, F.raise_error(F.lit("a component is too large for exact scores"))).otherwise(F.transform("x", lambda c: F.floor(scale * c)))
    return sound.select("id", "label", F.size("x").alias("dim"), v.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers, or of multiples of it, as rows of doubles."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    n = len(flat) // dim if dim else len(column)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)


def _cut(size: int):
    """Runs of at most ``size`` rows with equal dim and part, from rows in order."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, part = (batch.column(c).to_numpy() for c in ("dim", "part"))
            fresh = np.flatnonzero(np.concatenate(([True], (dim[1:] != dim[:-1]) | (part[1:] != part[:-1]))))
            ends = [*fresh[1:], len(dim)]
            starts = np.concatenate([np.arange(a, b, size) for a, b in zip(fresh, ends)])
            ends = np.append(starts[1:], len(dim))
            at = pa.array(np.append(starts, len(dim)).astype(np.int32))
            nested = lambda c: pa.ListArray.from_arrays(at, batch.column(c))
            v = batch.column("v")
            offsets = v.offsets.to_numpy() - v.offsets[0].as_py()
            flat = v.flatten()
            lists = pa.ListArray.from_arrays(pa.array(offsets[np.append(starts, len(dim))].astype(np.int32)), flat)
            values = flat.to_numpy()
            span = lambda f: pa.array([f(values[offsets[a] : offsets[b]].reshape(b - a, -1), axis=0) if dim[a] else [] for a, b in zip(starts, ends)], pa.list_(pa.int64()))
            key = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("dim").take(pa.array(starts)), batch.column("part").take(pa.array(starts)), pa.array(np.minimum.reduceat(key, starts)), pa.array(np.maximum.reduceat(key, starts)),
                 nested("id"), nested("label"), lists, span(np.min), span(np.max)],
                ["dim", "part", "near", "far", "ids", "labels", "flat", "lows", "highs"],
            )

    return run


def stored_blocks(rows: DataFrame, order: list, size: int = BLOCK) -> tuple[DataFrame, str]:
    """Rows (id, label, dim, v, part, key) written as blocks, cut from the order of ``order``; a block holds one dim and one part.

    ``near`` and ``far`` are the least and greatest key of a block, ``lows`` and ``highs``
    the least and greatest value of each component.
    """
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(many, *order).sortWithinPartitions(*order).select("id", "label", "dim", "v", "part", "key")
    schema = "dim int, part int, near double, far double, ids array<long>, labels array<string>, flat array<long>, lows array<long>, highs array<long>"
    return written(map_arrow(ordered, _cut(size), schema).withColumn("block", F.monotonically_increasing_id()), "blocks")


def _merge(best: np.ndarray, names: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Puts the new scores of ``rows`` among their best, by score and then id."""
    better = (scores >= best[rows, -1:]) & (scores > -np.inf)
    some = better.any(axis=1)
    if not some.any():
        return
    rows, k = rows[some], best.shape[1]
    all_scores = np.concatenate((best[rows], np.where(better[some], scores[some], -np.inf)), axis=1)
    all_names = np.concatenate((names[rows], np.broadcast_to(ids, (len(rows), len(ids)))), axis=1)
    order = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
    best[rows], names[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_names, order, 1)


def scan(queries: pa.Table, blocks: pa.Table, bounds: Bounds, k: int, same: bool | None, first: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Best scores and ids of each query (rows of k, -inf where there are fewer), and how many pairs of a query and a block were scored.

    ``same``: only rows of the query's label, only others, or all. ``first``: no more
    than so many blocks a query.
    """
    dim = int(queries["dim"][0].as_py())
    x = matrix(queries["v"], dim)
    own, labels = queries["id"].to_numpy(), np.array(queries["label"].to_pylist(), object)
    number = lambda name, other: np.array([other if v is None else v for v in queries[name].to_pylist()], np.float64)
    least, most = number("least", -np.inf), number("most", np.inf)
    upper, lower = bounds(x, blocks, dim)
    upper = np.where((lower > most[:, None]) | (upper < least[:, None]), -np.inf, np.minimum(upper, most[:, None]))
    order = np.argsort(-upper, axis=1, kind="stable")
    held = [(matrix(blocks["flat"].slice(b, 1), dim), np.array(blocks["ids"][b].as_py(), np.int64), np.array(blocks["labels"][b].as_py(), object)) for b in range(blocks.num_rows)]
    best, names = np.full((len(x), k), -np.inf), np.full((len(x), k), LAST_ID)
    known, live, scored = number("floor", -np.inf), np.arange(len(x)), 0
    for place in range(blocks.num_rows if first is None else min(first, blocks.num_rows)):
        block = order[live, place]
        bound = upper[live, block]
        on = (bound >= np.maximum(known[live], best[live, -1])) & (bound > -np.inf)
        live, block = live[on], block[on]
        if not len(live):
            break
        scored += len(live)
        for b in np.unique(block):
            rows = live[block == b]
            y, ids, kinds = held[b]
            s = x[rows] @ y.T
            ok = (ids != own[rows, None]) & (s >= np.maximum(least, known)[rows, None]) & (s <= most[rows, None])
            if same is not None:
                ok &= (kinds == labels[rows, None]) == same
            _merge(best, names, rows, np.where(ok, s, -np.inf), ids)
    return best, names, scored


def _cell(bounds: Bounds, k: int, same: bool | None, first: int | None):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not queries.num_rows or not blocks.num_rows:
            best, names = np.empty((0, k)), np.empty((0, k), np.int64)
        else:
            best, names, _ = scan(queries, blocks, bounds, k, same, first)
        q = queries["q"].to_numpy()[: len(best)]
        if first is not None:
            full = best[:, -1] > -np.inf
            return pa.table({"q": q[full], "floor": best[full, -1].astype(np.int64)})
        row, column = np.nonzero(best > -np.inf)
        return pa.table({"q": q[row], "id": names[row, column], "score": best[row, column].astype(np.int64)})

    return run


def search(blocks: DataFrame, queries: DataFrame, bounds: Bounds, k: int, same: bool | None = None) -> DataFrame:
    """(q, rank, id, score): the ``k`` best rows of every query by score, then id; rank from 1.

    ``queries`` (q, id, label, dim, v, least, most) is a written table with a number q
    of its own for each row; scores are taken from ``least`` to ``most`` (null: open), and
    never with a row of the query's id. Only vectors of one length meet.
    """
    ship(queries.sparkSession)
    shards = blocks.groupBy("dim").agg(F.ceil(F.greatest(F.lit(1.0), F.sum(F.size("flat")) / SHARD_VALUES)).cast("int").alias("s"))
    groups = queries.groupBy("dim").agg(F.ceil(F.greatest(F.lit(1.0), F.count(F.lit(1)) * F.col("dim") / GROUP_VALUES)).cast("int").alias("g"))
    plan, plan_path = written(shards.join(groups, "dim"), "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = blocks.join(plan, "dim").withColumn("shard", F.pmod(F.xxhash64("block"), F.col("s")).cast("int")).withColumn("group", every("g")).drop("s", "g")

    def over_cells(asks: DataFrame, first: int | None, schema: str) -> DataFrame:
        sent = asks.join(plan, "dim").withColumn("group", F.pmod(F.xxhash64("q"), F.col("g")).cast("int")).withColumn("shard", every("s")).drop("s", "g")
        keys = ["dim", "group", "shard"]
        return sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_cell(bounds, k, same, first), schema)

    asks = queries.withColumn("floor", F.lit(None).cast("long"))
    if (plan.agg(F.max("s").alias("s")).first().s or 0) > 1:
        floors = over_cells(asks, FIRST_BLOCKS, "q long, floor long").groupBy("q").agg(F.max("floor").alias("floor"))
        floors, floors_path = written(floors, "floors")
        asks = queries.join(floors, "q", "left")
    else:
        floors_path = None
    found, _ = written(over_cells(asks, None, "q long, id long, score long"), "found")
    for path in (plan_path, floors_path):
        if path:
            forget(queries.sparkSession, path)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "rank", "id", "score")


def asked(rows: DataFrame, which: str) -> tuple[DataFrame, str]:
    """Rows for which the SQL condition ``which`` on ``id`` holds, as queries without limits."""
    open_ = F.lit(None).cast("long")
    return written(rows.where(which).select("id", "label", "dim", "v", open_.alias("least"), open_.alias("most")).withColumn("q", F.monotonically_increasing_id()), "queries")
