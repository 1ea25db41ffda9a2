"""The life of a judgement: pending, running, then completed, skipped or failed, or expired where none comes in time.

Events: response_id, at (timestamp), kind, score. Kinds are ``asked`` and
``request_failed`` for the response, ``judging`` for the start, and the outcomes
``judged``, ``skipped`` and ``judge_failed``. Of several outcomes the earliest
counts, ties by kind and score (nulls first); one that is later than ``within`` after
the question comes too late. A failed request is never judged; outcomes without a
response give no row; rows without an id, a time or a known kind are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = {"judged": "completed", "skipped": "skipped", "judge_failed": "failed"}
WITHIN = "1 day"


def known(events: DataFrame) -> DataFrame:
    kinds = ["asked", "request_failed", "judging", *OUTCOMES]
    return events.where(F.col("response_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(kinds)).select("response_id", "at", "kind", F.col("score").cast("double").alias("score"))


def judge_states(events: DataFrame, now, within: str = WITHIN) -> DataFrame:
    """(response_id, asked_at, judge_status, score, settled_at) as of ``now`` (a column).

    Sums and minima that combine before the shuffle; the stream of the same events
    (``streaming.judging``) ends with the same rows.
    """
    at = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("at")))
    outcome = F.min(F.when(F.col("kind").isin(*OUTCOMES), F.struct("at", "kind", "score")))
    g = known(events).groupBy("response_id").agg(
        at("asked", "request_failed").alias("asked_at"), at("request_failed").alias("failed_at"), at("judging").alias("started_at"), outcome.alias("o")
    ).where("asked_at is not null")
    deadline = F.col("asked_at") + F.expr(f"interval {within}")
    in_time = F.coalesce(F.col("o.at") <= deadline, F.lit(False)) & F.col("failed_at").isNull()
    named = F.lit(None)
    for kind, status in OUTCOMES.items():
        named = F.when(F.col("o.kind") == kind, status).otherwise(named)
    status = (
        F.when(F.col("failed_at").isNotNull(), "not_run").when(in_time, named).when(F.lit(now) > deadline, "expired")
        .when(F.col("started_at").isNotNull(), "running").otherwise("pending")
    )
    return g.select("response_id", "asked_at", status.alias("judge_status"), F.when(in_time, F.col("o.score")).alias("score"), F.when(in_time, F.col("o.at")).alias("settled_at"))
