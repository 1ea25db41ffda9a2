"""The step of op8 in which members of different components of a bucket meet."""

from millrace.llm import minhash


def test_settle_joins_the_sets_once(spark):
    live = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 2, 2)], "key long, node long, tag long, component long")
    full = spark.createDataFrame([(1, [1, 2]), (2, [1, 2])], "node long, shingles array<long>")
    found = minhash._settle(live, full, 80)
    assert {frozenset(r) for r in found.collect()} == {frozenset((1, 2))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (node") == 1
