"""The Python API: search, answers with a pluggable generator or agent, tools, filters, stats, feedback.

Search builds lazy plans; only an answer's few top rows reach the driver. The
language model, the agent and the embedding function are callables that the
caller supplies; ``extractive`` stands in for a model in tests.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calculator import evaluate
from ..operators import search

Generator = Callable[[str, str], str]
Agent = Callable[[str, str, dict], dict]
Embedder = Callable[[str], list[float]]
NOTHING_FOUND = "No relevant documents were found."
MODES, PIPELINES = ("keyword", "vector", "hybrid"), ("rag", "agent")
COMPACT = ["source_id", "content_type", "ticker", "report_year", "page_start", "page_end", "section_title", "text", "score"]


@dataclass(frozen=True)
class Request:
    """A question; bounds are checked when it is made."""

    question: str
    session_id: str = ""
    pipeline: str = "rag"
    retrieval_mode: str = "hybrid"
    top_k: int = 8
    ticker: str | None = None
    report_year: int | None = None
    model: str = "extractive"

    def __post_init__(self):
        if not 1 <= len(self.question) <= 4000:
            raise ValueError("question must have 1 to 4000 characters")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be 1 to 50")
        if self.pipeline not in PIPELINES or self.retrieval_mode not in MODES:
            raise ValueError("unknown pipeline or retrieval mode")


@dataclass
class Answer:
    response_id: str
    pipeline: str
    answer: str
    results: list[dict] = field(default_factory=list)
    context: str = ""
    tool_calls: list[dict] = field(default_factory=list)
    timing: dict = field(default_factory=dict)


def extractive(question: str, context: str) -> str:
    """The first line of text of the context's first source."""
    body = context.split("\n\n", 1)[-1]
    return body.split("\n", 1)[0] if context else NOTHING_FOUND


class Engine:
    """An index (retrieval rows with ``embedding``), optional tables (table_id, table_data) and an embedding function."""

    def __init__(self, docs: DataFrame, embed: Embedder, tables: DataFrame | None = None):
        self.docs, self.embed, self.tables, self.spark = docs, embed, tables, docs.sparkSession

    def health(self) -> dict:
        return {"status": "healthy" if self.spark.sql("SELECT 1").first()[0] == 1 else "unhealthy"}

    def filters(self) -> dict:
        row = self.docs.agg(F.sort_array(F.collect_set("ticker")).alias("tickers"), F.sort_array(F.collect_set("report_year")).alias("years")).first()
        return row.asDict()

    def stats(self) -> dict:
        row = self.docs.agg(
            F.count(F.lit(1)).alias("documents"), F.countDistinct("ticker").alias("companies"), F.countDistinct("report_year").alias("years"),
            F.count_if(F.col("content_type") == "table").alias("tables"), F.count_if(F.col("content_type") == "narrative").alias("narratives"),
        ).first()
        return row.asDict()

    def search(self, question: str, mode: str = "hybrid", top_k: int = 8, ticker: str | None = None, report_year: int | None = None) -> DataFrame:
        vector = self.embed(question) if mode != "keyword" else None
        return search.retrieve(self.docs, question, mode=mode, vector=vector, top_k_=top_k, ticker=ticker, report_year=report_year)

    def _tool(self, mode: str, question: str, **kw) -> dict:
        """Search as a tool: an error is a result, never raised."""
        try:
            rows = [r.asDict() for r in self.search(question, mode, **kw).select(*COMPACT).collect()]
            return {"success": True, "count": len(rows), "documents": rows}
        except Exception as e:  # noqa: BLE001
            return {"success": False, "error_type": type(e).__name__, "error": str(e)}

    def search_keyword(self, question: str, **kw) -> dict:
        return self._tool("keyword", question, **kw)

    def search_semantic(self, question: str, **kw) -> dict:
        return self._tool("vector", question, **kw)

    def search_hybrid(self, question: str, **kw) -> dict:
        return self._tool("hybrid", question, **kw)

    def get_table(self, table_id: str) -> dict:
        try:
            row = None if self.tables is None else self.tables.where(F.col("table_id") == table_id).first()
            return {"success": True, "found": row is not None, "table": row.asDict(recursive=True) if row else None}
        except Exception as e:  # noqa: BLE001
            return {"success": False, "error_type": type(e).__name__, "error": str(e)}

    def tools(self) -> dict[str, Callable]:
        return {"search_keyword": self.search_keyword, "search_semantic": self.search_semantic, "search_hybrid": self.search_hybrid, "get_table": self.get_table, "calculate": evaluate}

    def query(self, request: Request, generator: Generator = extractive, agent: Agent | None = None) -> Answer:
        """Retrieve, assemble the context, and answer; without results nothing is generated."""
        began = time.perf_counter()
        mode = request.retrieval_mode if request.pipeline == "rag" else "hybrid"
        found = self.search(request.question, mode, request.top_k, request.ticker, request.report_year)
        rows = [r.asDict() for r in found.orderBy("rank").collect()]
        retrieved = time.perf_counter()
        out = Answer(str(uuid.uuid4()), request.pipeline, NOTHING_FOUND, rows)
        if rows:
            kind = found.schema
            out.context = search.build_context(self.spark.createDataFrame([tuple(r[c] for c in kind.names) for r in rows], kind)).first()[0]
        if request.pipeline == "agent":
            if agent is None:
                raise ValueError("the agent pipeline needs an agent")
            reply = agent(request.question, out.context, self.tools())
            out.answer = next((reply[k] for k in ("answer", "final_answer", "text") if reply.get(k)), "")
            out.tool_calls = next((reply[k] for k in ("tool_calls", "tools_used") if reply.get(k)), [])
        elif rows:
            out.answer = generator(request.question, out.context)
        done = time.perf_counter()
        out.timing = {"retrieval_seconds": retrieved - began, "generation_seconds": done - retrieved, "total_seconds": done - began}
        return out


def interaction_row(spark: SparkSession, request: Request, answer: Answer | None, error: str | None = None) -> DataFrame:
    """A row for the log; a failed request keeps neither ticker nor year and is never judged."""
    failed = answer is None
    row = (
        answer.response_id if answer else str(uuid.uuid4()), request.session_id, request.question, None if failed else answer.answer, request.pipeline, request.retrieval_mode,
        None if failed else request.ticker, None if failed else request.report_year, request.model, "failed" if failed else "completed", 0.0 if failed else answer.timing["total_seconds"],
        "not_run" if failed else "pending", error,
    )
    kind = "response_id string, session_id string, question string, answer string, pipeline string, retrieval_mode string, ticker string, report_year int, model string, status string, total_latency_seconds double, judge_status string, error_text string"
    return spark.createDataFrame([row], kind).withColumn("created_at", F.current_timestamp())


def feedback_row(spark: SparkSession, response_id: str, rating: int) -> DataFrame:
    if rating not in (1, -1):
        raise ValueError("rating must be 1 or -1")
    return spark.createDataFrame([(response_id, rating)], "response_id string, rating int").withColumn("updated_at", F.current_timestamp())
