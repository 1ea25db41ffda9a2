import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, lines, minhash, vectors
from tests.llm import brute

DOCS = "doc_id long, text string"


def near_copies(seed, n=120):
    """Short and long texts with copies that differ in a few words."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 30, 80]))))
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [1, 2, 5])
def test_minhash_equals_all_pairs(spark, size):
    docs = near_copies(size)
    got = minhash.near_duplicates(spark.createDataFrame(docs, DOCS), shingle=size).collect()
    want = brute.near_duplicates(docs, size)
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_minhash_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t", "x"), (4, "A b", "x"), (5, "a  B", "x"), (None, "a b", "x"), (6, "one", "x"), (6, "one", "x"), (7, "\u00a0", "x"), (8, "w " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("key", F.lit(1)).withColumn("fp", F.lit("z"))
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=2).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True)], key=str)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_sketch_agrees_with_the_similarity():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        x = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = np.unique(x[:54]), np.unique(x[6:])  # similarity 48 / 60
        agree.append(np.mean(minhash.sketch(a, 256, 1) == minhash.sketch(b, 256, 1)))
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_star_rounds_lose_no_link(spark):
    """A chain in one bucket: the head is linked with one member only."""
    rows = [(1, k, 0) for k in range(12)]
    buckets = spark.createDataFrame(rows, "key long, node long, tag long")
    found = components.link_buckets(buckets, lambda pairs: pairs.where("abs(a - b) = 1").select("a", "b"))
    assert {r.id: r.component for r in found.collect()} == dict.fromkeys(range(12), 0)


def test_star_of_many_leaves(spark):
    """A hub of 300,000 leaves in many tasks; the check of rounds adds no numbers up that could overflow."""
    edges = spark.range(1, 300_001, numPartitions=16).selectExpr("id as a", "0L as b")
    got = components.connected_components(edges)
    assert got.count() == 300_001 and got.where("component <> 0").isEmpty()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 1)], [(1, 1), (2, None), (9, 8), (8, 7), (3, 7), (20, 21)]])
def test_components(spark, edges):
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == brute.components({n for e in real for n in e}, real)


def line_docs(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 6, 25, 60]))) for _ in range(60)]
    docs = []
    for i in range(50):
        own = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(pool).split(" ")
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            own.append(("  " if rng.random() < 0.2 else " ").join(words).upper() if rng.random() < 0.2 else " ".join(words))
        docs.append((i, "\n".join(own)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_all_pairs(spark, seed):
    docs = line_docs(seed)
    got = lines.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((r.row.doc_id, r.text, r.n_removed) for r in got) == brute.dedup_lines(docs)


def edited(rng, line, edits):
    words = line.split(" ")
    for i in sorted(rng.sample(range(len(words)), min(edits, len(words))), reverse=True):
        kind, other = rng.choice(["letter", "change", "insert", "drop"]), "".join(rng.choice("abcdefgh") for _ in range(6))
        if kind == "letter":
            at = rng.randrange(len(words[i]))
            words[i] = words[i][:at] + "z" + words[i][at + 1 :]
        else:
            words[i : i + 1] = {"change": [other], "insert": [words[i], other], "drop": []}[kind]
    return " ".join(words)


def test_line_recall_against_edit_similarity(spark, sf_dir):
    """Lines of the test table with edits planted in one word, two words and a tenth of the words: at least 0.9 of the pairs that edit similarity alone finds, in every class of length."""
    rng = random.Random(3)
    text = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    norms = sorted({" ".join(x.lower().split()) for t in text for x in t.split("\n")} - {""})
    norms = [n for n in norms if len(n) < 2000]
    tried, found = {}, {}
    # every line has one copy, as copies of one line would find each other
    rng.shuffle(norms)
    pairs = [(n, edited(rng, n, (1, 2, max(1, len(n.split(" ")) // 10))[k % 3])) for k, n in enumerate(norms[:1200])]
    pairs = [(a, b) for a, b in pairs if b and a != b and brute.similar(a, b)]
    docs = [(2 * k + side, p[side]) for k, p in enumerate(pairs) for side in (0, 1)]
    got = {r.row.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    for k, (a, _) in enumerate(pairs):
        size = sum(len(a.split(" ")) >= x for x in (5, 10, 20, 40, 80))
        tried[size], found[size] = tried.get(size, 0) + 1, found.get(size, 0) + got[2 * k + 1]
    print({k: (tried[k], round(found[k] / tried[k], 3)) for k in sorted(tried)})
    assert len(tried) == 6 and all(found[k] >= 0.9 * tried[k] for k in tried if k)


def test_bound_is_never_below_the_distance(spark):
    rng = random.Random(4)
    rows = [((a := " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 14)))), edited(rng, a, rng.randint(0, 4))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", "split(a, ' ') as wa", "split(b, ' ') as wb")
    got = df.selectExpr("a", "b", lines.aligned("wa", "wb") + " as d").collect()
    assert all(r.d >= brute.levenshtein(r.a, r.b) for r in got)
    assert sum(r.d == brute.levenshtein(r.a, r.b) for r in got) > 100


def test_a_run_that_many_unlike_lines_share(spark):
    """One passage in a thousand lines, of which a few are alike: crowded buckets are dealt anew, and the like ones still meet."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(12))
    texts = [" ".join(word() for _ in range(14)) + " " + passage + " " + " ".join(word() for _ in range(14)) for _ in range(400)]
    texts += [edited(rng, t, 1) for t in texts[:40]]
    got = {r.row.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {i: int(i >= 400) for i in range(440)}


def test_lines_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, None, 7), (2, "", 7), (3, "one two three four five\nshort\nshort", 7), (4, "x\nOne two three four five", 7), (None, "One two three four five", 7), (5, long, 7), (6, long + " end", 7), (7, "a b\nc d", 7), (7, "a b\nc d", 7), (7, "x y z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int").withColumn("pos", F.lit(0)).withColumn("gone", F.lit(0)).withColumn("row", F.lit(1))
    got = {(r.row.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got == {(1, None, 0), (2, "", 0), (3, "short", 2), (4, "x", 1), (None, "One two three four five", 0), (5, long, 0), (6, "", 1), (7, "a b\nc d", 0), (7, "x y z", 0)}
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.02, 0.1, 0.15)]).astype(np.float32)
    label = rng.integers(0, 3, 60).tolist() * 4
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label))]
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), lists=8).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if label[i] == label[j] and y[i] @ y[j] >= 0.98]
    comp = brute.components(range(len(x)), links)
    n = {i: sum(i in e for e in links) for i in range(len(x))}
    assert len(links) > 50 and got == {i: (n[i], comp[i], comp[i] == i) for i in range(len(x))}


def test_vectors_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [], 1), (12, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("point", F.lit(0)).withColumn("cell", F.lit(0))
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)}
    assert vectors.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("copies,block", [(1, 4096), (3, 40)])
def test_quantised_search_finds_all(spark, sf_dir, monkeypatch, copies, block):
    """Recall against brute force on the test table with planted near copies: all links, with lists and queries in blocks too."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in v], float)
    x = np.concatenate([x, *(x[:60] + rng.normal(size=x[:60].shape) * s * np.abs(x).mean() for s in (0.1, 0.2, 0.3)[:copies])])
    lab = np.array([r.label for r in v] + [r.label for r in v[:60]] * copies)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((y @ y.T >= 0.98) & (lab[:, None] == lab)).sum(axis=1) - 1
    rows = [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, lab))]
    got = {r.id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == dict(enumerate(want.tolist())) and want.sum() > 100
