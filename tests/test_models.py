import pytest
from pyspark.sql import functions as F

from millrace.operators import models


def test_a_batch_is_retried_and_then_taken_apart():
    calls = []

    def model(batch):
        calls.append(len(batch))
        if "bad" in batch:
            raise RuntimeError("no")
        return [x.upper() for x in batch]

    assert models.call_batch(model, ["a", "bad", "c"], 3, 0.0) == [("A", None), (None, "no"), ("C", None)]
    assert calls == [3, 3, 3, 1, 1, 1]
    assert models.call_batch(lambda b: b[:1], ["a", "b"], 1, 0.0)[1] == ("b", None)
    assert models.call_batch(lambda b: [KeyError()], ["a"], 1, 0.0) == [(None, "KeyError")]


def made():
    state = {"calls": 0, "largest": 0}

    def model(batch):
        state["calls"] += 1
        state["largest"] = max(state["largest"], len(batch))
        if state["calls"] == 1:
            raise ConnectionError("first")
        return [f"{x}:{state['largest']}" if x != "bad" else ValueError("refused") for x in batch]

    return model


def test_column_with_nulls_errors_and_clashing_names(spark):
    rows = [(i, None if i % 10 == 3 else "bad" if i % 10 == 7 else f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "value int, text string").coalesce(1).withColumn("error", F.lit("own")).withColumn("i0", F.lit(0))
    got = df.withColumn("call", models.model_column("made", made, "string", F.col("text"), batch=16, pause=0.0)).collect()
    assert len(got) == 200 and all(r.error == "own" for r in got)
    for r in got:
        want = (None, None) if r.text is None else (None, "refused") if r.text == "bad" else (f"{r.text}:16", None)
        assert tuple(r.call) == want
    assert df.where("false").withColumn("call", models.model_column("made", made, "string", F.col("text"))).count() == 0


@pytest.mark.parametrize("out", [[1.0], [1.0, float("nan")], [1.0, float("inf")], [1.0, None], []])
def test_vectors_that_are_none(spark, out):
    r = models.with_embeddings(spark.createDataFrame([("x",)], "text string"), lambda: lambda batch: [out for _ in batch], 2, name=f"m{out}").first()
    assert r.embedding is None and r.embedding_error
