"""Model calls as columns: one model a worker, small batches, retries, and an error in the row instead of a failed job.

A model is made by a function without arguments and takes a list of texts (or of
tuples, for several inputs) to a list of results of the same length; a result may
be an exception, which is that row's error. A batch whose call fails is tried again
with growing pauses; then its rows are tried alone, so that one bad row costs no other
its result. What is left has a null value and the error's text.

The columns are not deterministic for the optimiser, which then calls once a row. A
lost executor calls again for its rows: write the result before it is used twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .validate import valid_scores

BATCH, ATTEMPTS, PAUSE, LONGEST_PAUSE = 32, 4, 0.5, 8.0

_models: dict[str, Callable] = {}


def _model(name: str, make: Callable) -> Callable:
    """The worker's own model, made at the first call."""
    if name not in _models:
        _models[name] = make()
    return _models[name]


def call_batch(model: Callable, batch: list, attempts: int, pause: float) -> list[tuple[object, str | None]]:
    """(value, error) of each input of a batch."""
    said: Exception | None = None
    for n in range(attempts):
        if n:
            time.sleep(min(pause * 2 ** (n - 1), LONGEST_PAUSE))
        try:
            out = list(model(batch))
            if len(out) != len(batch):
                raise ValueError(f"{len(out)} results for {len(batch)} inputs")
            return [(None, str(v) or type(v).__name__) if isinstance(v, Exception) else (v, None) for v in out]
        except Exception as e:  # a model may raise anything; what it says goes to the rows
            said = e
    if len(batch) == 1:
        return [(None, str(said) or type(said).__name__)]
    return [r for x in batch for r in call_batch(model, [x], 1, pause)]


def model_column(name: str, make: Callable, kind: str, *inputs: Column, batch: int = BATCH, attempts: int = ATTEMPTS, pause: float = PAUSE) -> Column:
    """Struct (value, error) of the model over ``inputs``; rows with a null input are not sent and have neither.

    ``name`` tells models of a worker apart; ``kind`` is the SQL type of the value.
    """

    alone = len(inputs) == 1

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, make)
        for chunk in chunks:
            rows = list(chunk.itertuples(index=False, name=None))
            sent = [i for i, r in enumerate(rows) if all(x is not None and x == x for x in r)]
            value, error = [None] * len(rows), [None] * len(rows)
            for at in range(0, len(sent), batch):
                part = sent[at : at + batch]
                for i, (v, e) in zip(part, call_batch(model, [rows[i][0] if alone else rows[i] for i in part], attempts, pause)):
                    value[i], error[i] = v, e
            yield pd.DataFrame({"value": pd.Series(value, dtype=object), "error": pd.Series(error, dtype=object)})

    run.__annotations__ = {"chunks": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, f"value {kind}, error string").asNondeterministic()(F.struct(*(c.alias(f"i{n}") for n, c in enumerate(inputs))))


def with_embeddings(docs: DataFrame, make: Callable, size: int, text_col: str = "text", *, name: str = "embedding", **options) -> DataFrame:
    """Adds ``embedding`` and ``embedding_error``; a vector of another length than ``size``, or with a component that is no number, is an error."""
    ship(docs.sparkSession)
    called = docs.withColumn("__call", model_column(name, make, "array<double>", F.col(text_col), **options))
    v = F.col("__call.value")
    sound = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    error = F.coalesce("__call.error", F.when(v.isNotNull() & ~sound, F.lit("not a vector of the size asked for")))
    return called.withColumns({"embedding": F.when(sound, v), "embedding_error": error}).drop("__call")


def with_judgements(answers: DataFrame, make: Callable, metrics: tuple[str, ...], *inputs: str, name: str = "judge", **options) -> DataFrame:
    """Adds a score for each metric and ``judge_error``; the model gives JSON, each metric an object with score (0 to 1) and reason."""
    ship(answers.sparkSession)
    called = answers.withColumn("__call", model_column(name, make, "string", *(F.col(c) for c in inputs), **options)).withColumn("__s", valid_scores(F.col("__call.value"), metrics))
    valid = F.col("__s.valid")
    error = F.coalesce("__call.error", F.when(F.col("__call.value").isNotNull() & ~valid, F.lit("not a valid judgement")))
    return called.withColumns({**{m: F.when(valid, F.col(f"__s.{m}")) for m in metrics}, "judge_error": error}).drop("__call", "__s")
