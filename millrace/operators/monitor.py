"""Monitoring: log upserts, the joined view, and the dashboard's panels.

Upserts are latest-wins merges by aggregation (``max_by`` combines before the
shuffle), not windows. Panels take a time range; hourly panels fill gaps from a
generated series that is as long as the range, not the data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LATENCY = 0.1


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert: of all rows of a key the one with the largest ``version``; a new row wins a tie."""
    columns = old.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*columns).withColumn("__new", F.lit(1)))
    best = both.select(*keys, F.struct(version, "__new").alias("__v"), F.struct(*columns).alias("__r")).groupBy(*keys).agg(F.max_by("__r", "__v").alias("r"))
    return best.select("r.*")


def sessions(interactions: DataFrame) -> DataFrame:
    """First and last sight of each session."""
    return interactions.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("last_seen_at"))


def latest_feedback(events: DataFrame) -> DataFrame:
    """One rating a response, the last by (rated_at, event_id); ratings other than 1 and -1 are refused."""
    ok = events.where(F.col("rating").isin(1, -1))
    return ok.groupBy("response_id").agg(F.max_by("rating", F.struct("rated_at", "event_id")).alias("rating"), F.min("rated_at").alias("created_at"), F.max("rated_at").alias("updated_at"))


def split_interactions(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interactions, model calls) of finished requests whose calls are an array ``llm_calls``; calls are numbered from 0."""
    calls = requests.select("response_id", "created_at", F.posexplode("llm_calls").alias("call_index", "c")).select("response_id", "call_index", "c.*", "created_at")
    return requests.drop("llm_calls").withColumns({"status": F.lit("completed"), "judge_status": F.lit("pending")}), calls


def failed_interactions(errors: DataFrame) -> DataFrame:
    """Interactions of requests that failed: never judged, without ticker and year."""
    return errors.withColumns({"status": F.lit("failed"), "judge_status": F.lit("not_run"), "ticker": F.lit(None).cast("string"), "report_year": F.lit(None).cast("int")})


def judge_calls(judgements: DataFrame, calls: DataFrame) -> DataFrame:
    """Model calls of judges, numbered after the calls that a response has; to append to ``calls``."""
    last = calls.groupBy("response_id").agg(F.max("call_index").alias("last"))
    rows = judgements.join(last, "response_id", "left").withColumn("call_index", (F.coalesce("last", F.lit(-1)) + 1).cast("int")).withColumn("purpose", F.lit("judge"))
    return rows.select(*calls.columns)


def apply_judgements(interactions: DataFrame, judgements: DataFrame) -> DataFrame:
    """Keyed update of score, reason and status from (response_id, score, status); rows without one keep their values."""
    j = judgements.select("response_id", F.col("score").alias("__s"), F.col("status").alias("__t"))
    return interactions.join(j, "response_id", "left").withColumns({
        "relevance_score": F.coalesce("__s", "relevance_score"), "judge_status": F.coalesce("__t", "judge_status"),
    }).drop("__s", "__t")


def response_monitoring(interactions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Interactions with their rating, if any."""
    return interactions.join(feedback.select("response_id", "rating", F.col("updated_at").alias("feedback_at")), "response_id", "left")


def in_range(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return df.where(F.col("created_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def answered(df: DataFrame) -> DataFrame:
    """Completed, and not so fast that nothing can have run."""
    return df.where((F.col("status") == "completed") & (F.col("total_latency_seconds") >= LEAST_LATENCY))


def judged(df: DataFrame) -> DataFrame:
    return df.where((F.col("judge_status") == "completed") & F.col("relevance_score").isNotNull())


def stat_panels(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Single numbers. The count of responses covers all time, the others the range."""
    inside = F.col("created_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    ok = inside & (F.col("status") == "completed") & (F.col("total_latency_seconds") >= LEAST_LATENCY)
    scored = inside & (F.col("judge_status") == "completed")
    total = lambda c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("responses"), F.round(F.avg(F.when(ok, F.col("total_latency_seconds"))), 6).alias("avg_latency_seconds"),
        F.round(total("application_cost_usd"), 9).alias("application_cost_usd"), F.round(total("judge_cost_usd"), 9).alias("judge_cost_usd"),
        F.round(F.avg(F.when(scored, F.col("relevance_score"))), 6).alias("average_relevance"),
    )


def thumbs_up_rate(df: DataFrame, feedback: DataFrame, start: datetime, end: datetime) -> DataFrame:
    rated = in_range(df, start, end).join(feedback, "response_id", "left")
    return rated.agg(F.round(100.0 * F.count_if(F.col("rating") == 1) / F.nullif(F.count("rating"), F.lit(0)), 6).alias("thumbs_up_percent"))


def responses_over_time(df: DataFrame, start: datetime, end: datetime, width: str = "5 minutes") -> DataFrame:
    return in_range(df, start, end).groupBy(F.window("created_at", width).start.cast("timestamp_ntz").alias("time")).agg(F.count(F.lit(1)).alias("responses"))


def latency_over_time(df: DataFrame, start: datetime, end: datetime, width: str = "5 minutes") -> DataFrame:
    return answered(in_range(df, start, end)).groupBy(F.window("created_at", width).start.cast("timestamp_ntz").alias("time")).agg(F.round(F.avg("total_latency_seconds"), 6).alias("latency"))


def hours(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Every hour of the range, as ``time``."""
    bound = lambda t: F.date_trunc("hour", F.lit(t)).cast("timestamp_ntz")
    return df.sparkSession.range(1).select(F.explode(F.sequence(bound(start), bound(end), F.expr("interval 1 hour"))).alias("time"))


def _by_hour(df: DataFrame, *aggregates) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("time")).agg(*aggregates)


def cost_by_hour(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Costs of every hour, 0 where nothing happened."""
    costs = _by_hour(in_range(df, start, end), F.sum("application_cost_usd").alias("a"), F.sum("judge_cost_usd").alias("j"))
    zero = F.lit(0.0)
    return hours(df, start, end).join(costs, "time", "left").select("time", F.round(F.coalesce("a", zero), 10).alias("application_cost"), F.round(F.coalesce("j", zero), 10).alias("judge_cost"))


def relevance_by_hour(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Mean relevance of every hour, null where nothing was judged."""
    scores = _by_hour(judged(in_range(df, start, end)), F.round(F.avg("relevance_score"), 6).alias("relevance"))
    return hours(df, start, end).join(scores, "time", "left").select("time", "relevance")


def latency_by_pipeline(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return answered(in_range(df, start, end)).groupBy("pipeline").agg(F.round(F.avg("total_latency_seconds"), 6).alias("avg_latency"))


def feedback_by_pipeline(df: DataFrame, feedback: DataFrame, start: datetime, end: datetime) -> DataFrame:
    rated = in_range(df, start, end).join(feedback, "response_id", "left")
    return rated.groupBy("pipeline").agg(F.count_if(F.col("rating") == 1).alias("thumbs_up"), F.count_if(F.col("rating") == -1).alias("thumbs_down"))


def recent(df: DataFrame, feedback: DataFrame, start: datetime, end: datetime, n: int = 100) -> DataFrame:
    """The last ``n`` interactions; the cut comes before the join, as a response has one rating at most."""
    last = in_range(df, start, end).orderBy(F.col("created_at").desc(), "response_id").limit(n)
    mark = F.when(F.col("rating") == 1, "👍").when(F.col("rating") == -1, "👎").otherwise("—")
    return last.join(feedback.select("response_id", "rating"), "response_id", "left").select(
        F.col("created_at").alias("time"), "response_id", "pipeline", "question", F.round("total_latency_seconds", 6).alias("latency_seconds"),
        F.col("application_cost_usd").alias("app_cost_usd"), "relevance_score", "judge_status", mark.alias("feedback"), "status",
    )


def call_totals(calls: DataFrame) -> DataFrame:
    """Token and cost sums of each response over its model calls."""
    names = ("input_tokens", "output_tokens", "thinking_tokens", "total_tokens", "cost_usd")
    return calls.groupBy("response_id").agg(F.count(F.lit(1)).alias("calls"), *(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names))
