"""Queries read whole tables, against plain Python."""

import hashlib
from collections import defaultdict
from math import log2

from millrace.plans import evaluation, ingestion


def test_retrieval_metrics_rank_all_vectors(spark, tmp_path):
    rows = [(i, i % 7) for i in range(330)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for q in range(0, 330, 50):
        gold = {i for i, label in rows if label == q % 7}
        hit = [i in gold for i in sorted(range(330), key=lambda i: hashlib.sha256(f"{q}|{i}".encode()).hexdigest())[:20]]
        gain, best = (sum(x / log2(k + 2) for k, x in enumerate(h[:8])) for h in (hit, [1] * len(gold)))
        want[q] = (sum(hit[:8]) / 8, sum(hit[:8]) / len(gold), float(any(hit[:8])), 1 / (hit.index(True) + 1) if any(hit) else 0.0, gain / best)
    got = {r[0]: tuple(r[1:]) for r in evaluation.retrieval_metrics(spark, str(tmp_path)).collect()}
    assert got == {q: tuple(round(x, 6) for x in v) for q, v in want.items()}
    means = evaluation.metric_means(spark, str(tmp_path)).first()
    assert means["total"] == 7 and abs(means["mean_recall_at_k"] - sum(v[1] for v in want.values()) / 7) < 2e-6


def test_tool_metrics_and_calculator_read_all_rows(spark, tmp_path):
    kinds = ["view", "error", "click"]
    events = [(i, 10 * (i % 13), kinds[i * i % 7 % 3]) for i in range(200)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    calls = defaultdict(list)
    for i, user, kind in events:
        calls[user].append((kind, i % 5 == 0 or kind != "error"))
    want = {}
    for user, c in calls.items():
        used = {kind for kind, _ in c}
        want[user] = (len(c), round(sum(ok for _, ok in c) / len(c), 6), round(2 * len(used & {"view", "refund"}) / (len(used) + 2), 6))
    assert {r.user_id: (r.calls, r.tool_success_rate, r.tool_f1) for r in evaluation.tool_metrics(spark, str(tmp_path)).collect()} == want
    parts = [(i, i % 50 + 1) for i in range(0, 1200, 7)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: (r.success, r.result) for r in evaluation.calculator(spark, str(tmp_path)).collect()}
    assert got == {i: (True, round((n + 2) * 3 - n / 4 // 1 % 7, 6)) for i, n in parts}


def test_text_forms_tell_long_file_names_apart(spark, tmp_path):
    texts = ["word " * 30 + "a", "word " * 30 + "b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.file for r in ingestion.text_forms(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [hashlib.sha256(t.replace(" ", "_").encode()).hexdigest() for t in texts]
