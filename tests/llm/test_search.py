"""Hard negatives and exact top-k against all pairs in numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from millrace.llm import cells, negatives, topk

VECTORS = "vec_id long, embedding array<double>, label int"


def clustered(n=900, dim=16, centres=12, seed=4):
    """Vectors around a few centres, some repeated exactly, so that scores tie."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + n // 9] = x[7]
    return [(i, x[i].tolist(), int(i % 5)) for i in range(n)]


def scaled(rows):
    return [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), lab) for i, v, lab in rows]


def dot(a, b):
    return int((a * b).sum())


def brute_topk(rows, k=5, every=50):
    x = scaled(rows)
    out = []
    for i, v, _ in x:
        if i % every == 0:
            best = sorted((-dot(v, w), j) for j, w, _ in x if j != i and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows, every=50):
    x = scaled(rows)
    out = []
    for i, v, lab in x:
        if i % every:
            continue
        scores = [(-dot(v, w), j, m) for j, w, m in x if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scores if s[2] == lab)[:5]:
            p = -p
            fit = sorted((s, n) for s, n, m in scores if m != lab and 50 * p <= -100 * s <= 95 * p)[:3]
            out += [(i, j, r, n, p, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def got_topk(df, **options):
    return sorted(tuple(r) for r in topk.top_k(df, "id % 50 = 0", **options).collect())


def got_negatives(df, **options):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, "id % 50 = 0", **options).collect())


@pytest.fixture
def small_cells(monkeypatch):
    """Several shards, groups and blocks for few rows, so that both passes run."""
    monkeypatch.setattr(cells, "SHARD_VALUES", 2000)
    monkeypatch.setattr(cells, "GROUP_VALUES", 100)


def test_topk_equals_all_pairs_over_many_cells(spark, small_cells):
    rows = clustered()
    assert got_topk(spark.createDataFrame(rows, VECTORS), block=16) == brute_topk(rows)


def test_negatives_equal_all_pairs_over_many_cells(spark, small_cells):
    rows = clustered()
    assert got_negatives(spark.createDataFrame(rows, VECTORS), block=16, pivots=6) == brute_negatives(rows)


def test_random_vectors_that_no_bound_can_prune(spark, small_cells):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=24).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    assert got_topk(df, block=32) == brute_topk(rows) and got_negatives(df, block=32) == brute_negatives(rows)


def _blocks(x, size, order):
    y = x[order]
    cut = [y[a : a + size] for a in range(0, len(y), size)]
    return pa.table({
        "part": pa.array(np.zeros(len(cut), np.int32)), "flat": [b.astype(np.int64).ravel().tolist() for b in cut], "ids": [list(order[a : a + size]) for a in range(0, len(y), size)],
        "labels": [[""] * len(b) for b in cut], "lows": [b.min(0).astype(np.int64).tolist() for b in cut], "highs": [b.max(0).astype(np.int64).tolist() for b in cut],
    })


def test_term_bounds_spare_most_blocks_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32)) * 200
    x = np.floor(np.repeat(centres, 64, axis=0) + rng.normal(size=(2560, 32)) * 10)
    blocks = _blocks(x, 64, np.arange(len(x)))
    ask = np.arange(0, len(x), 64)
    queries = pa.table({"id": ask, "label": [""] * len(ask), "dim": np.full(len(ask), 32, np.int32), "v": [x[i].astype(np.int64).tolist() for i in ask], "least": pa.nulls(len(ask)), "most": pa.nulls(len(ask)), "floor": pa.nulls(len(ask))})
    best, names, scored = cells.scan(queries, blocks, topk.term_bounds, 5, None, None)
    s = x[ask] @ x.T
    s[np.arange(len(ask)), ask] = -np.inf
    assert (np.sort(s, axis=1)[:, ::-1][:, :5] == best).all() and (np.take_along_axis(s, names, 1) == best).all()
    assert scored <= 2 * len(ask) < 0.1 * len(ask) * blocks.num_rows


def test_interval_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    x = np.floor(np.tile(rng.normal(size=(5, 8)) * 100, (100, 1)) + rng.normal(size=(500, 8)) * 3)
    model = negatives.Pivots(int((x * x).sum(1).max()), negatives.Pivots(int((x * x).sum(1).max()), np.empty((0, 9))).augmented(x[:5]))
    pivot, key = model.keys(x)
    order = np.lexsort((key, pivot))
    runs = [r for p in np.unique(pivot) for r in np.array_split(order[pivot[order] == p], 7) if len(r)]
    table = pa.table({"part": pivot[[r[0] for r in runs]], "near": [key[r].min() for r in runs], "far": [key[r].max() for r in runs]})
    upper, lower = negatives.interval_bounds({8: model})(x[:50], table, 8)
    s = x[:50] @ x.T
    for b, r in enumerate(runs):
        assert (s[:, r] <= upper[:, [b]]).all() and (s[:, r] >= lower[:, [b]]).all()
    assert (upper < np.sort(s, axis=1)[:, [-5]]).mean() > 0.2  # and they leave some intervals out


def test_vectors_without_a_part_ties_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (50, [1.0, 0.0], 2), (3, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (1, [0.9, 0.1], 1), (4, [0.6, 0.9], 2), (5, [0.7, 0.0], 3),
        (100, [1.0, 2.0, 3.0], 1), (101, [1.0, 2.0, 2.0], 1), (102, [1.0, 2.0, 1.0], 2), (150, [], 1), (151, [], 1), (200, [-1.0, -0.5], 4), (201, [-0.5, 1.0], 4),
    ]
    left_out = [(7, None, 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (250, [nan, 0.0], 1)]
    df = spark.createDataFrame(rows + left_out, VECTORS)
    clash = df.selectExpr("*", "1 as id", "'x' as v", "2 as dim", "3 as part", "4 as q", "5 as score", "6 as block", "7 as `rank`")
    want = brute_topk(rows)
    assert got_topk(df) == want and got_topk(clash) == want
    want = brute_negatives(rows)
    assert got_negatives(df) == want and got_negatives(clash) == want and want
    unlabelled = df.unionByName(spark.createDataFrame([(300, [1.0, 0.0], None), (6, [0.8, 0.0], None)], VECTORS))
    assert got_negatives(unlabelled) == want


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.6, 0.0], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    assert got_topk(df) == sorted(2 * [(0, 1, 1, 230 * 256), (0, 2, 1, 230 * 256), (0, 3, 2, 153 * 256)])
    assert got_negatives(df) == 4 * [(0, 1, 1, 2, 230 * 256, 153 * 256)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert got_topk(empty) == [] and got_negatives(empty) == []
    none_asked = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], VECTORS)
    assert got_topk(none_asked) == [] and got_negatives(none_asked) == []


def test_components_too_large_for_exact_scores_are_an_error(spark):
    with pytest.raises(PySparkException):
        got_topk(spark.createDataFrame([(0, [1e9, 1.0], 1), (1, [1.0, 1.0], 1)], VECTORS))
