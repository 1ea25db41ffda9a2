"""The life of a judgement as a stream: keyed state with a timer for each response.

The state of a response is a handful of values. Each batch that changes what is
known gives out a row with a higher ``version``; the last of a response is its state,
and ``monitor.upsert_stream`` keeps a table of them. When the watermark passes the
deadline an open response expires, and the state goes. Events that are later than
the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.judging import OUTCOMES, known
from ..shipping import ship

STATES = "response_id string, version long, asked_at timestamp, judge_status string, score double, settled_at timestamp"
_STATE = "version long, asked long, failed boolean, started boolean, at long, kind string, score double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Judgements(StatefulProcessor):
    """Times are microseconds since 1970; timers are milliseconds, rounded up."""

    def __init__(self, within_us: int):
        self.within = within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("judgement", _STATE)

    def _row(self, key, s: tuple, expired: bool) -> pd.DataFrame:
        version, asked, failed, started, at, kind, score = s
        in_time = at is not None and not failed and at <= asked + self.within
        status = "not_run" if failed else OUTCOMES[kind] if in_time else "expired" if expired else "running" if started else "pending"
        time = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        row = (key[0], version, time(asked), status, score if in_time else None, time(at) if in_time else None)
        out = pd.DataFrame([row], columns=[c.split(" ")[0] for c in STATES.split(", ")])
        return out.astype({"asked_at": "datetime64[us]", "settled_at": "datetime64[us]", "score": "float64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else (0, None, False, False, None, None, None)
        version, asked, failed, started, at, kind, score = before
        best = None if at is None else (at, kind, score is not None, score or 0.0)
        first_seen = None
        for pdf in rows:
            for us, k, x in zip(pdf["us"], pdf["kind"], pdf["score"]):
                us, x = int(us), None if x is None or x != x else float(x)
                first_seen = us if first_seen is None else min(first_seen, us)
                if k in ("asked", "request_failed"):
                    asked, failed = us if asked is None else min(asked, us), failed or k == "request_failed"
                elif k == "judging":
                    started = True
                else:
                    new = (us, k, x is not None, x or 0.0)
                    best = new if best is None else min(best, new)
        at, kind, score = (None, None, None) if best is None else (best[0], best[1], best[3] if best[2] else None)
        after = (version + 1, asked, failed, started, at, kind, score)
        if before[0] and after[1:] == before[1:]:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-((asked if asked is not None else first_seen) + self.within) // 1000) + 1)
        self.state.update(after)
        if asked is not None:
            yield self._row(key, after, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            version, *rest = self.state.get()
            settled = (version + 1, *rest)
            self.state.clear()
            if rest[0] is not None and (rest[3] is None or rest[3] > rest[0] + self.within) and not rest[1]:
                yield self._row(key, settled, True)

    def close(self) -> None:
        pass


def judge_lifecycle(events: DataFrame, within_seconds: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """Changes of state (``STATES``) from a stream of events as in ``operators.judging``; output mode update.

    Sets the session's state store to RocksDB, which keyed state with timers needs.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(spark)
    rows = known(events).withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    keyed = rows.groupBy("response_id")
    return keyed.transformWithStateInPandas(statefulProcessor=_Judgements(within_seconds * 1_000_000), outputStructType=STATES, outputMode="Update", timeMode="EventTime")
