"""Queries of the monitoring log: upserts, view, panels, costs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.scores import sampled
from ..operators import judging as jd
from ..operators import monitor as m
from ..sources import fixtures as fx

START, END = datetime(2024, 1, 3, 6, 30), datetime(2024, 1, 20, 18, 15)
_BETWEEN = "created_at BETWEEN TIMESTAMP '2024-01-03 06:30:00' AND TIMESTAMP '2024-01-20 18:15:00'"
_INTER, _FB = f"WITH {fx.SQL['inter']}", fx.SQL["fb"]
_OK = f"{_BETWEEN} AND status = 'completed' AND total_latency_seconds >= 0.1"
_HOURS = "b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03 06:00:00', TIMESTAMP '2024-01-20 18:00:00', INTERVAL 1 HOUR)) AS time)"


def _feedback(spark, sf_dir):
    return m.latest_feedback(fx.feedback_events(spark, sf_dir))


def stat_panels(spark, sf_dir):
    """The five single-number panels."""
    return m.stat_panels(fx.interactions(spark, sf_dir), START, END)


def thumbs_up_rate(spark, sf_dir):
    """Share of rated responses in the range that were liked."""
    return m.thumbs_up_rate(fx.interactions(spark, sf_dir), _feedback(spark, sf_dir), START, END)


def responses_over_time(spark, sf_dir):
    """Responses in buckets of five minutes."""
    return m.responses_over_time(fx.interactions(spark, sf_dir), START, END)


def latency_over_time(spark, sf_dir):
    """Mean latency in buckets of five minutes."""
    return m.latency_over_time(fx.interactions(spark, sf_dir), START, END)


def cost_by_hour(spark, sf_dir):
    """Hourly costs, gaps filled with 0."""
    return m.cost_by_hour(fx.interactions(spark, sf_dir), START, END)


def relevance_by_hour(spark, sf_dir):
    """Hourly mean relevance, gaps left null."""
    return m.relevance_by_hour(fx.interactions(spark, sf_dir), START, END)


def latency_by_pipeline(spark, sf_dir):
    """A16."""
    return m.latency_by_pipeline(fx.interactions(spark, sf_dir), START, END)


def feedback_by_pipeline(spark, sf_dir):
    """A17, J2."""
    return m.feedback_by_pipeline(fx.interactions(spark, sf_dir), _feedback(spark, sf_dir), START, END)


def recent_interactions(spark, sf_dir):
    """The last hundred."""
    return m.recent(fx.interactions(spark, sf_dir), _feedback(spark, sf_dir), START, END)


def response_view(spark, sf_dir):
    """Interactions with their rating."""
    return m.response_monitoring(fx.interactions(spark, sf_dir), _feedback(spark, sf_dir)).select("response_id", "session_id", "pipeline", "status", "created_at", "judge_status", "rating", "feedback_at")


def session_upsert(spark, sf_dir):
    """First and last sight of each session."""
    return m.sessions(fx.interactions(spark, sf_dir))


def feedback_upsert(spark, sf_dir):
    """Last rating of each response."""
    return _feedback(spark, sf_dir)


def key_merge(spark, sf_dir):
    """K1: customers merged with new balances for every third, latest version wins."""
    old = fx.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.lit(1).alias("version"))
    new = old.where("c_custkey % 3 = 0").withColumn("balance", F.round(F.col("balance") + 100, 2)).withColumn("version", F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(0))
    return m.merge_by_key(old, new, ["c_custkey"], "version")


def judge_update(spark, sf_dir):
    """Keyed update of scores and states."""
    i = fx.interactions(spark, sf_dir)
    j = i.where("cast(response_id as long) % 7 = 0 and status = 'completed'").select("response_id", F.lit(0.5).alias("score"), F.lit("completed").alias("status"))
    return m.apply_judgements(i, j).groupBy("judge_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("relevance_score"), 6).alias("relevance"))


def judge_lifecycle(spark, sf_dir):
    """Every response's state of judging at the time of the last event, late and repeated outcomes included."""
    events = fx.judge_events(spark, sf_dir)
    now = fx.read(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp_ntz").alias("t")).first().t
    return jd.judge_states(events, now)


LIFE_SQL = f"""WITH {fx.JUDGE_EVENTS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w, kind, score NULLS FIRST) AS r FROM jl WHERE kind IN ('judged', 'skipped', 'judge_failed')),
g AS (SELECT id, min(w) FILTER (kind IN ('asked', 'request_failed')) AS asked_at, count(*) FILTER (kind = 'request_failed') > 0 AS failed, count(*) FILTER (kind = 'judging') > 0 AS started FROM jl GROUP BY id),
s AS (SELECT g.*, o.w, o.kind, o.score, coalesce(o.w <= asked_at + INTERVAL 1 DAY, false) AND NOT failed AS in_time FROM g LEFT JOIN o ON o.id = g.id AND o.r = 1)
SELECT id::VARCHAR AS response_id, asked_at, CASE WHEN failed THEN 'not_run' WHEN in_time THEN CASE kind WHEN 'judged' THEN 'completed' WHEN 'skipped' THEN 'skipped' ELSE 'failed' END
  WHEN (SELECT max(ts) FROM je) > asked_at + INTERVAL 1 DAY THEN 'expired' WHEN started THEN 'running' ELSE 'pending' END AS judge_status, CASE WHEN in_time THEN score END AS score, CASE WHEN in_time THEN w END AS settled_at FROM s"""


def judge_sample(spark, sf_dir):
    """Responses drawn for judging by their digest."""
    return fx.read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("response_id")).where(sampled(F.col("response_id"), 0.25))


def token_costs(spark, sf_dir):
    """Tokens and dollars by model; an unknown model costs nothing."""
    return fx.interactions(spark, sf_dir).groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("application_cost_usd"), 6).alias("cost_usd"))


def call_totals(spark, sf_dir):
    """Sums over one to three model calls of each response."""
    i = fx.interactions(spark, sf_dir).withColumn("id", F.col("response_id").cast("long"))
    calls = i.select("response_id", "input_tokens", "output_tokens", "thinking_tokens", F.explode(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int"))).alias("call"))
    calls = calls.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("thinking_tokens")).withColumn("cost_usd", F.lit(0.5) * F.col("call"))
    return m.call_totals(calls)


def failed_rows(spark, sf_dir):
    """Failed interactions have no judge run."""
    return fx.interactions(spark, sf_dir).where("status = 'failed'").select("response_id", "status", "judge_status", "judge_cost_usd")


QUERIES = {
    "stat_panels": (stat_panels, f"""{_INTER} SELECT count(*) AS responses, round(avg(total_latency_seconds) FILTER ({_OK}), 6) AS avg_latency_seconds, round(coalesce(sum(application_cost_usd) FILTER ({_BETWEEN}), 0), 9) AS application_cost_usd,
  round(coalesce(sum(judge_cost_usd) FILTER ({_BETWEEN}), 0), 9) AS judge_cost_usd, round(avg(relevance_score) FILTER ({_BETWEEN} AND judge_status = 'completed'), 6) AS average_relevance FROM inter"""),
    "thumbs_up_rate": (thumbs_up_rate, f"{_INTER}, {_FB} SELECT round(100.0::DOUBLE * count(*) FILTER (rating = 1) / nullif(count(rating), 0), 6) AS thumbs_up_percent FROM inter i LEFT JOIN fb USING (response_id) WHERE i.{_BETWEEN}"),
    "responses_over_time": (responses_over_time, f"{_INTER} SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS time, count(*) AS responses FROM inter WHERE {_BETWEEN} GROUP BY 1"),
    "latency_over_time": (latency_over_time, f"{_INTER} SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS time, round(avg(total_latency_seconds), 6) AS latency FROM inter WHERE {_OK} GROUP BY 1"),
    "cost_by_hour": (cost_by_hour, f"""{_INTER}, {_HOURS}, c AS (SELECT date_trunc('hour', created_at) AS time, sum(application_cost_usd) AS a, sum(judge_cost_usd) AS j FROM inter WHERE {_BETWEEN} GROUP BY 1)
SELECT b.time, round(coalesce(a, 0), 10) AS application_cost, round(coalesce(j, 0), 10) AS judge_cost FROM b LEFT JOIN c USING (time)"""),
    "relevance_by_hour": (relevance_by_hour, f"""{_INTER}, {_HOURS}, c AS (SELECT date_trunc('hour', created_at) AS time, round(avg(relevance_score), 6) AS relevance FROM inter WHERE {_BETWEEN} AND judge_status = 'completed' AND relevance_score IS NOT NULL GROUP BY 1)
SELECT b.time, relevance FROM b LEFT JOIN c USING (time)"""),
    "latency_by_pipeline": (latency_by_pipeline, f"{_INTER} SELECT pipeline, round(avg(total_latency_seconds), 6) AS avg_latency FROM inter WHERE {_OK} GROUP BY 1"),
    "feedback_by_pipeline": (feedback_by_pipeline, f"{_INTER}, {_FB} SELECT pipeline, count(*) FILTER (rating = 1) AS thumbs_up, count(*) FILTER (rating = -1) AS thumbs_down FROM inter i LEFT JOIN fb USING (response_id) WHERE i.{_BETWEEN} GROUP BY 1"),
    "recent_interactions": (recent_interactions, f"""{_INTER}, {_FB} SELECT i.created_at AS time, response_id, pipeline, question, round(total_latency_seconds, 6) AS latency_seconds, application_cost_usd AS app_cost_usd, relevance_score, judge_status,
  CASE WHEN rating = 1 THEN '👍' WHEN rating = -1 THEN '👎' ELSE '—' END AS feedback, status FROM inter i LEFT JOIN fb USING (response_id) WHERE i.{_BETWEEN} ORDER BY i.created_at DESC, response_id LIMIT 100"""),
    "response_view": (response_view, f"{_INTER}, {_FB} SELECT response_id, session_id, pipeline, status, i.created_at, judge_status, rating, updated_at AS feedback_at FROM inter i LEFT JOIN fb USING (response_id)"),
    "session_upsert": (session_upsert, f"{_INTER} SELECT session_id, min(created_at) AS created_at, max(created_at) AS last_seen_at FROM inter GROUP BY 1"),
    "feedback_upsert": (feedback_upsert, f"WITH {_FB} SELECT response_id, rating, created_at, updated_at FROM fb"),
    "key_merge": (key_merge, "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN round(c_acctbal + 100, 2) ELSE c_acctbal END AS balance, CAST(CASE WHEN c_custkey % 6 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM customer"),
    "judge_update": (judge_update, f"""{_INTER}, u AS (SELECT CASE WHEN status = 'completed' AND CAST(response_id AS BIGINT) % 7 = 0 THEN 0.5::DOUBLE ELSE relevance_score END AS s, CASE WHEN status = 'completed' AND CAST(response_id AS BIGINT) % 7 = 0 THEN 'completed' ELSE judge_status END AS t FROM inter)
SELECT t AS judge_status, count(*) AS n, round(avg(s), 6) AS relevance FROM u GROUP BY 1"""),
    "judge_lifecycle": (judge_lifecycle, LIFE_SQL),
    "judge_sample": (judge_sample, f"{_INTER} SELECT response_id FROM inter WHERE judge_sampled"),
    "token_costs": (token_costs, f"{_INTER} SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(application_cost_usd), 6) AS cost_usd FROM inter GROUP BY 1"),
    "call_totals": (call_totals, f"""{_INTER}, c AS (SELECT *, unnest(range(1, CAST(response_id AS BIGINT) % 3 + 2)) AS call FROM inter)
SELECT response_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(thinking_tokens) AS BIGINT) AS thinking_tokens,
  CAST(sum(input_tokens + output_tokens + thinking_tokens) AS BIGINT) AS total_tokens, sum(0.5::DOUBLE * call) AS cost_usd FROM c GROUP BY 1"""),
    "failed_rows": (failed_rows, f"{_INTER} SELECT response_id, status, judge_status, judge_cost_usd FROM inter WHERE status = 'failed'"),
}
