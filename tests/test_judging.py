from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import judging
from millrace.sources import fixtures as fx
from millrace.streaming import judging as stream

EVENTS = "response_id string, at timestamp, kind string, score double"
T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def last_states(changes):
    best = {}
    for r in changes:
        if r.response_id not in best or best[r.response_id].version < r.version:
            best[r.response_id] = r
    return {k: (r.asked_at, r.judge_status, r.score, r.settled_at) for k, r in best.items()}


def replay(spark, batches, folder, name):
    """Runs the stream over the batches in order; ends far beyond every deadline."""
    schema = batches[0].schema
    for n, b in enumerate([*batches, spark.createDataFrame([("end", datetime(2100, 1, 1), "judging", None)], EVENTS), spark.createDataFrame([("end", datetime(2100, 1, 2), "judging", None)], EVENTS)]):
        b.select(*schema.names).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"batch={n:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))
    changes = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    q = stream.judge_lifecycle(source, delay="3 hours").writeStream.outputMode("update").foreachBatch(lambda df, _: changes.extend(df.collect())).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    q.stop()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert q.exception() is None
    return changes


def test_rules_of_the_states(spark):
    rows = [
        ("done", at(0), "asked", None), ("done", at(1), "judging", None), ("done", at(3), "judged", 0.9), ("done", at(2), "judged", None), ("done", at(2), "judge_failed", 0.1),
        ("late", at(0), "asked", None), ("late", at(24.01), "judged", 0.5), ("edge", at(0), "asked", None), ("edge", at(24), "skipped", None),
        ("open", at(40), "asked", None), ("run", at(40), "asked", None), ("run", at(41), "judging", None), ("none", at(0), "request_failed", None), ("none", at(1), "judged", 1.0),
        ("lost", at(1), "judged", 1.0), (None, at(0), "asked", None), ("x", None, "asked", None), ("y", at(0), "other", None), ("twice", at(30), "asked", None), ("twice", at(29), "asked", None),
    ]
    df = spark.createDataFrame(rows, EVENTS).withColumn("now", F.lit(1))
    got = {r.response_id: (r.judge_status, r.score, r.settled_at) for r in judging.judge_states(df, at(45)).collect()}
    assert got == {
        "done": ("failed", 0.1, at(2)), "late": ("expired", None, None), "edge": ("skipped", None, at(24)), "open": ("pending", None, None), "run": ("running", None, None),
        "none": ("not_run", None, None), "twice": ("pending", None, None),
    }
    assert judging.judge_states(df.where("false"), at(45)).count() == 0


def test_stream_equals_batch_with_events_out_of_order(spark, tmp_path):
    rows = [
        ("a", at(0), "asked", None), ("b", at(1), "asked", None), ("c", at(2), "judged", 0.7), ("d", at(0), "asked", None), ("e", at(0), "request_failed", None), ("f", at(0), "asked", None), ("g", at(0), "judged", 0.2),
        ("c", at(1.5), "asked", None), ("a", at(3), "judged", 0.4), ("a", at(2.5), "skipped", None), ("b", at(3), "judging", None), ("e", at(2), "judged", 0.3),
        ("a", at(4), "judged", 0.9), ("d", at(23), "judged", 0.1), ("b", at(26), "judged", 0.8),
    ]
    batches = [spark.createDataFrame(rows[a:b], EVENTS) for a, b in ((0, 7), (7, 12), (12, 15))]
    changes = replay(spark, batches, tmp_path, "small")
    batch = judging.judge_states(spark.createDataFrame(rows, EVENTS), datetime(2100, 1, 1)).collect()
    want = {r.response_id: (r.asked_at, r.judge_status, r.score, r.settled_at) for r in batch}
    assert last_states(changes) == want
    assert {k: v[1] for k, v in want.items()} == {"a": "skipped", "b": "expired", "c": "completed", "d": "completed", "e": "not_run", "f": "expired"}
    # pending, then running, then expired, each with a higher version
    assert [r.judge_status for r in sorted((r for r in changes if r.response_id == "b"), key=lambda r: r.version)][-1] == "expired"


def test_stream_equals_batch_on_the_events(spark, sf_dir, tmp_path):
    log = fx.judge_events(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp")).where("cast(response_id as long) % 4 = 0")
    ends = log.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    step = (ends.b - ends.a) / 4
    cuts = [ends.a + step * i for i in range(1, 4)]
    part = sum((F.col("at") >= F.lit(c)).cast("int") for c in cuts)
    batches = [log.where(part == i) for i in range(4)]
    changes = replay(spark, batches, tmp_path, "events")
    batch = judging.judge_states(log, datetime(2100, 1, 1)).collect()
    assert last_states(changes) == {r.response_id: (r.asked_at, r.judge_status, r.score, r.settled_at) for r in batch}
    assert {r.judge_status for r in batch} >= {"completed", "skipped", "failed", "expired", "not_run"}
