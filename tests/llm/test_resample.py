"""Importance resampling against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

from millrace.llm import resample

DOCS = "doc_id long, text string"


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10000


def brute(docs, target):
    """Sorted (doc_id, n_words, n_features, weight, score, rank)."""
    s, t = (Counter(bucket(g) for _, text in rows for g in grams(text)[1]) for rows in (docs, target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (ns + 10000) / ((s[k] + 1) * (nt + 10000))))
    rows = []
    for i, text in docs:
        w, g = grams(text)
        weight, score = sum(gain(bucket(x)) for x in g), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(w), len(g), weight, score, None])
    long = [r for r in rows if r[1] >= 20]
    for rank, r in enumerate(sorted((r for r in long if r[4] is not None), key=lambda r: (-r[4], r[0]))[: 5 * len(long) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=str)


def got(spark, docs, target):
    found = resample.importance_resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame(target, "item_id string, text string"))
    return sorted(map(tuple, found.collect()), key=str)


def corpus(n=400):
    words = ["Alpha", "beta", "ÉTÉ", "漢字", "x1", "gamma", "Straße", "end", "the"]
    return [(i, " ".join(words[(i * k * k + k) % (3 + i % 7)] + ("." if k % 5 else "") for k in range(5 + i % 60))) for i in range(n)]


def test_equals_plain_counting(spark):
    docs = [*corpus(), (900, None), (901, ""), (902, " .,;\n"), (903, "one"), (904, "Two WORDS"), (905, "w " * 150_000 + "end"), (905, "w " * 150_000 + "end"), (None, "alpha beta " * 20)]
    target = [("a", "alpha beta gamma alpha beta x1"), (None, "漢字 été the end"), ("c", None)]
    want = brute(docs, target)
    assert got(spark, docs, target) == want and sum(r[5] is not None for r in want) == 14


def test_runs_of_one_batch_share_no_features(monkeypatch):
    texts = [t.encode() for _, t in corpus(30)]
    whole = resample.run_buckets(texts, 997)
    for n, (values, sizes) in enumerate(whole):
        at = 0
        for text, size in zip(texts, sizes):
            alone = resample.run_buckets([text], 997)[n]
            assert alone[1][0] == size and (alone[0] == values[at : at + size]).all()
            at += size


def test_documents_longer_than_a_run(spark, monkeypatch):
    monkeypatch.setattr(resample, "RUN_BYTES", 50)
    docs = corpus(60)
    assert got(spark, docs, [("a", "alpha beta")]) == brute(docs, [("a", "alpha beta")])


def test_empty_tables_and_clashing_columns(spark):
    assert got(spark, [], [("a", "x")]) == []
    docs = corpus(50)
    assert got(spark, docs, []) == brute(docs, [])
    clash = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as id", "2 as score", "3 as `rank`", "4 as part", "5 as n_words")
    found = resample.importance_resample(clash, spark.createDataFrame([], "text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, [])
    rows = resample.drawn_documents(clash, spark.createDataFrame([("alpha",)], "text string")).collect()
    assert sorted(r["rank"] for r in rows) == [1] and all(r.row.text == dict(docs)[r.row.doc_id] and r.row.part == 4 for r in rows)


def test_drawn_documents_lean_to_the_target(spark):
    docs = [(i, ("query plan join index " if i % 4 == 0 else "rose lily tulip daisy ") * 6) for i in range(600)]
    found = resample.drawn_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("plan index join query " * 4,)], "text string"), share=0.2).collect()
    assert len(found) == 120 and sum(r.row.doc_id % 4 == 0 for r in found) >= 110
