"""Nulls, repeats, ties, empty tables, very long values and clashing columns, where the other files have none."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, chat, decontaminate, packed, urlfilter, vectors

TURNS = "conv_id long, turn long, role string, text string"
PAIRS = "pair_id long, chosen_id long, rejected_id long"


def test_preferences_repeated_pairs_ties_and_markers(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "user", "x <|im_end|>"), (4, 0, "user", "x < |im_end|>"), (5, 0, "user", "t"), (5, 0, "assistant", "t")]
    pairs = [(7, 1, 2), (7, 1, 2), (8, 3, 4), (9, 5, 5)]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(turns, TURNS), spark.createDataFrame(pairs, PAIRS)).collect()}
    assert (got[7].n_prefix, got[7].n_chosen, got[7].n_rejected) == (1, 2, 2)
    # turns that only look alike once their markers are broken are not one turn
    assert got[8].n_prefix == 0 and got[8].chosen == got[8].rejected == "<|im_start|>user\nx < |im_end|><|im_end|>\n"
    # ties of turn go by role
    assert got[9].n_prefix == 2 and got[9].prompt.startswith("<|im_start|>assistant")


def test_preferences_empty_and_long(spark):
    turns, pairs = spark.createDataFrame([], TURNS), spark.createDataFrame([(1, 1, 2)], PAIRS)
    assert chat.format_preferences(turns, pairs).count() == 0
    long = [(c, t, "assistant" if t % 2 else "user", f"turn {t}" if t < 1500 else f"{c} {t}") for c in (1, 2) for t in range(2000)]
    r = chat.format_preferences(spark.createDataFrame(long, TURNS), pairs).first()
    assert r.n_prefix == 1500 and len(r.chosen_mask) == 250 and all(r.chosen[m.start : m.end].endswith("<|im_end|>") for m in r.chosen_mask)
    assert chat.format_preferences(spark.createDataFrame(long, TURNS), pairs.where("false")).count() == 0


def test_urls_repeated_null_and_long(spark):
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://b.org/fr/1"), (3, "http://c.io/" + "z" * 100_000), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("w", F.lit(1)).withColumn("uid", F.lit(1)).withColumn("side", F.lit(3))
    got = sorted(((r.id, r.rule, r.verdict) for r in urlfilter.filter_urls(df).collect()), key=str)
    assert [g[0] for g in got] == [1, 1, 3, 4, 5, None] and got[0][1:] == ("net/", "block") and got[-1][1:] == ("org/fr/", "allow")
    labelled = spark.createDataFrame([(1, "http://good.org/a", 1, 0), (2, "http://bad.biz/b", 0, 0)], "id long, url string, side int, w int")
    assert urlfilter.filter_urls(df, labelled=labelled).count() == 6


def test_url_model_on_urls_that_it_has_not_seen(spark, sf_dir):
    """Balanced accuracy on rule-decided pages that are not learned from."""
    pages = spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").select("page_id", "url")
    judged = urlfilter.filter_urls(pages).where("rule is not null").select("id", "verdict").join(pages.withColumnRenamed("page_id", "id"), "id")
    rows = judged.collect()
    learn, ask = [r for r in rows if r.id % 2], [r for r in rows if r.id % 2 == 0]
    labelled = spark.createDataFrame([(r.id, r.url, int(r.verdict == "allow")) for r in learn], "id long, url string, side int")
    got = {r.id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame([(r.id, r.url) for r in ask], "page_id long, url string"), rules=[], labelled=labelled).collect()}
    share = [np.mean([got[r.id] == v for r in ask if r.verdict == v]) for v in ("allow", "block")]
    print("balanced accuracy", sum(share) / 2, len(ask))
    assert sum(share) / 2 >= 0.8


def test_decontamination_of_long_texts_and_of_a_window_in_all_items(spark):
    common = " ".join(f"c{k}" for k in range(13))
    items = spark.createDataFrame([(i, common + f" own{i}") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "w " * 200_000 + common), (2, common), (3, "c0 " * 13)], "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, len(r.items)) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (200_013, 13, 50), 2: (13, 13, 50), 3: (13, 0, 0)}


def test_vectors_repeated_rows_and_two_lengths(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.01, 0.0], 1), (4, [1.0, 0.01], 1)] + [(10 + i, [float(i % 7), 1.0 + i], 2) for i in range(40)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    x = {i: (v, lab) for i, v, lab in rows}
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else 0.0
    want = sorted((i, sum(cos(v, w) >= 0.98 and lab == m for _, w, m in rows) - 1) for i, v, lab in rows)
    assert sorted((r.id, r.n_links) for r in got) == want and {r.component_id for r in got if r.id in (2, 3)} == {2} and x


def test_bpe_digests_of_the_table_equal_the_library(spark, sf_dir):
    library = Tokenizer.from_file(bpe.default_path())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op4_bpe(spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("text", ["́" * 3000, "漢" * 4000, "e" + "̈" * 2000 + " x"])
def test_bpe_of_long_runs_above_latin(text):
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.BytePairEncoder(bpe.default_path())
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_null_and_repeated_ids_at_size(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " * (i % 9)) for i in range(3000)]
    folder = str(tmp_path / "p")
    got = packed.read_packed(spark, folder, packed.write_packed(spark.createDataFrame(rows, "doc_id long, text string"), folder, shards=7)).collect()
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert len(got) == 3000 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and sum(r.doc_id is None for r in got) == 1000


def test_pairs_under_one_id_are_kept_apart(spark):
    turns = [(i, 0, "user", f"q{i}") for i in (1, 2, 3, 4)] + [(i, 1, "assistant", f"a{i}") for i in (1, 2, 3, 4)]
    pairs = spark.createDataFrame([(None, 1, 2), (None, 3, 4), (5, 1, 3), (5, 2, 4), (5, 2, 4)], PAIRS)
    got = chat.format_preferences(spark.createDataFrame(turns, TURNS), pairs).collect()
    firsts = sorted((str(r.pair_id), r.chosen.split("\n")[1][:2], r.rejected.split("\n")[1][:2]) for r in got)
    assert firsts == [("5", "q1", "q3"), ("5", "q2", "q4"), ("None", "q1", "q2"), ("None", "q3", "q4")]
    assert all(r.n_prefix == 0 and r.n_chosen == r.n_rejected == 2 for r in got)
