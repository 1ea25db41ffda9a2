"""Schemas of the interaction log and of the tables that ingestion writes.

Keys and checks that a database would hold are named beside them; ``check`` counts
the rows that break one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSIONS = "session_id string not null, created_at timestamp, last_seen_at timestamp"
INTERACTIONS = (
    "response_id string not null, session_id string, created_at timestamp, pipeline string, question string, answer string, ticker string, report_year int, status string, error_type string, error_message string, "
    "sources string, tool_calls string, input_tokens long, output_tokens long, thinking_tokens long, total_tokens long, application_cost_usd decimal(16,10), retrieval_latency_seconds double, "
    "generation_latency_seconds double, total_latency_seconds double, judge_status string, relevance_score double, relevance_reason string, judge_cost_usd decimal(16,10)"
)
LLM_CALLS = "response_id string not null, call_index int, purpose string, model string, input_tokens long, output_tokens long, thinking_tokens long, total_tokens long, latency_seconds double, cost_usd decimal(16,10), created_at timestamp"
FEEDBACK = "response_id string not null, rating short, created_at timestamp, updated_at timestamp"
BLOCKS = "report_id string, page_number int, block_index int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, max_font_size double, median_font_size double, is_bold boolean"
MATRICES = "report_id string, page_number int, table_index int, tx0 double, ty0 double, tx1 double, ty1 double, matrix array<array<string>>"
MANIFEST = "company string, ticker string, report_year int, filename string, url string, validate_year boolean"

TABLES = {"sessions": SESSIONS, "interactions": INTERACTIONS, "llm_calls": LLM_CALLS, "feedback": FEEDBACK}
KEYS = {"sessions": ["session_id"], "interactions": ["response_id"], "llm_calls": ["response_id", "call_index"], "feedback": ["response_id"]}
CHECKS = {"interactions": "pipeline IN ('rag', 'agent') AND status IN ('completed', 'failed')", "feedback": "rating IN (-1, 1)"}


def create_log(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Empty tables of the log where there are none yet, and all of them as temporary views."""
    out = {}
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
        out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
        out[name].createOrReplaceTempView(name)
    return out


def broken(name: str, df: DataFrame) -> dict[str, int]:
    """How many rows break the table's key or check; a null in a check breaks nothing, as in SQL."""
    keys = KEYS[name]
    row = df.agg(F.count_if(~F.expr(CHECKS.get(name, "true"))).alias("check"), F.count_if(F.col(keys[0]).isNull()).alias("key_null")).first()
    repeats = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).first().n
    return {"check": row.check, "key_null": row.key_null, "key_repeats": repeats}
