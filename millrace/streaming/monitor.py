"""Structured Streaming forms of the log: panels with watermarks, latest-wins sinks, late judgements.

State is bounded by the watermark: buckets, unmatched responses and repeats
older than the delay leave it. Over a finished source each gives the rows of
its batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.monitor import LEAST_LATENCY, merge_by_key


def responses_over_time(interactions: DataFrame, width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Responses and mean latency of answered ones by bucket of ``created_at`` (a timestamp)."""
    ok = (F.col("status") == "completed") & (F.col("total_latency_seconds") >= LEAST_LATENCY)
    return (
        interactions.withWatermark("created_at", delay).groupBy(F.window("created_at", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("responses"), F.avg(F.when(ok, F.col("total_latency_seconds"))).alias("latency"))
        .select(F.col("w.start").alias("time"), "responses", "latency")
    )


def active_sessions(interactions: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a session's questions without a pause of ``gap``."""
    return (
        interactions.withWatermark("created_at", delay).groupBy("session_id", F.session_window("created_at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("questions")).select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "questions")
    )


def with_judgements(interactions: DataFrame, judgements: DataFrame, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Each interaction with the judgement that comes within a day, or with nulls once none can."""
    i = interactions.withWatermark("created_at", delay)
    j = judgements.select(F.col("response_id").alias("judged_id"), F.col("created_at").alias("judged_at"), "score").withWatermark("judged_at", delay)
    on = (F.col("response_id") == F.col("judged_id")) & (F.col("judged_at") >= F.col("created_at")) & (F.col("judged_at") <= F.col("created_at") + F.expr(f"interval {within}"))
    return i.join(j, on, "left_outer").drop("judged_id")


def without_repeats(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Events that a source delivers more than once, once."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(keys)


def upsert_stream(events: DataFrame, target: str, keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Keep ``target`` (Parquet, one folder a batch) at the latest row of each key.

    A batch writes a new folder named after its id and then points to it, so a
    batch that runs twice leaves the same table.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = latest_table(spark, target, batch_id)
        merged = merge_by_key(old if old is not None else batch.limit(0), batch, keys, version)
        merged.write.mode("overwrite").parquet(f"{target}/batch={batch_id:012d}")
        # the batch before stays for readers that have begun and for a batch that runs again
        for name in _batches(spark, target)[:-2]:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark, target: str) -> list[str]:
    """Names of the whole batches, in order."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    done = [s.getPath() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("batch=")]
    return sorted(p.getName() for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest_table(spark, target: str, before: int | None = None) -> DataFrame | None:
    """The table as of the last batch (before a batch), or None."""
    done = [d for d in _batches(spark, target) if before is None or int(d[6:]) < before]
    return spark.read.parquet(f"{target}/{done[-1]}") if done else None
