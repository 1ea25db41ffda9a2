import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import scores as s
from millrace.functions import tables as tb
from millrace.functions import text as tx
from millrace.functions.analysis import analyze, cover_density, matches, parse_query, query_words, simple_tokens, stem
from millrace.functions.calculator import calculate, evaluate
from millrace.operators.chunking import pack, pack_sentences
from millrace.operators.evaluate import target_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_clean_text(spark):
    raw = "Reve-\n nue  grew \xa0 fast \n\n\n\n now­here "
    assert one(spark, tx.clean_text(F.lit(raw))) == "Revenue grew fast\n\nnowhere"
    assert one(spark, tx.flatten(F.lit(raw))) == "Revenue grew fast nowhere"


def test_noise_and_headings(spark):
    for t, want in [("", True), ("| + |", True), ("12 345", True), ("abcd", True), ("Profit grew this year", False), (None, True)]:
        assert one(spark, tx.is_noise(F.lit(t).cast("string"))) is want
    heading = lambda t, bold=False, font=10.0: one(spark, tx.is_heading(F.lit(t), F.lit(bold), F.lit(font), F.lit(10.0)))
    assert heading("Risk management") and heading("Big words", True, 13.0)
    assert not heading("Risk management.") and not heading("Big words", True, 12.0) and not heading("12 / 5") and not heading("risk management " * 9)


def test_sentences_and_slices(spark):
    assert one(spark, tx.sentences(F.lit("A b. C d!  E"))) == ["A b.", "C d!", "E"]
    assert one(spark, tx.word_slices(F.lit("a b c d e"), 2)) == ["a b", "c d", "e"]
    assert one(spark, tx.word_slices(F.lit("  "), 2)) == []


def test_margin_form_masks_numbers(spark):
    assert one(spark, tx.margin_form(F.lit("Annual Report 25\n----"))) == "annual report <number>"


def test_repair_of_a_collapsed_row(spark):
    row = ["Profit before income tax 609,308 214,154 184.5% 107,984 88,605 21.9%"] + [""] * 6
    assert one(spark, tb.repair_row(F.array(*map(F.lit, row)), F.lit(7))) == ["Profit before income tax", "609,308", "214,154", "184.5%", "107,984", "88,605", "21.9%"]
    for kept in (["only words here", "", ""], ["1 2", "", ""], ["Tax 1 x 2", "", ""], ["Tax 1 2", "y", ""]):
        assert one(spark, tb.repair_row(F.array(*map(F.lit, kept)), F.lit(3))) == kept


def test_headers_and_records(spark):
    h = F.array(F.lit("a"), F.lit("a"), F.lit("a_2"), F.lit(""))
    assert one(spark, tb.unique_headers(h)) == ["a", "a_2", "a_2", "column_4"]
    m = F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(""), F.lit("")))
    assert one(spark, tb.records(F.array(F.lit("k"), F.lit("k")), m)) == [{"k": "y"}]
    repeated = F.array(F.array(F.lit(" NAME "), F.lit("key")), F.array(F.lit("q"), F.lit("1")))
    assert one(spark, tb.without_header_row(repeated, F.array(F.lit("Name"), F.lit("Key")))) == [["q", "1"]]


def test_worked_metrics(spark):
    ranked, gold = F.array(*map(F.lit, "abcde")), F.array(F.lit("b"), F.lit("d"))
    assert one(spark, s.precision_at(ranked, gold, 5)) == 0.4
    assert one(spark, s.recall_at(ranked, F.array(F.lit("b"), F.lit("z")), 5)) == 0.5
    for gold_id, want in (("a", 1.0), ("b", 0.5), ("d", 0.25), ("z", 0.0)):
        assert one(spark, s.reciprocal_rank(ranked, F.array(F.lit(gold_id)))) == want
    twice = F.array(F.lit("b"), F.lit("b"))
    assert one(spark, s.ndcg_at(twice, F.array(F.lit("b")), 5)) > 1
    assert one(spark, s.hit_at(F.array().cast("array<string>"), gold, 5)) == 0.0


def test_growth_of_the_worked_example(spark):
    g = one(spark, s.growth(F.lit(17761.152255), F.lit(14795.706831)))
    assert math.isclose(g, 20.042607344630493, rel_tol=1e-12)
    assert one(spark, s.money(F.lit(17761.152255), F.lit("ngn_billion"))) == "₦17.76tn"
    assert one(spark, s.signed_percent(F.lit(g))) == "+20.0%"
    assert one(spark, s.growth(F.lit(1.0), F.lit(0.0))) is None and one(spark, s.growth(F.lit(5.0), F.lit(-5.0))) == 200


def test_calculator(spark):
    assert evaluate("(609308 - 214154) / 214154 * 100")["result"] == pytest.approx(184.518, abs=1e-3)
    assert evaluate("-7 % 3")["result"] == 2 and evaluate("-7 // 2")["result"] == -4 and evaluate("sqrt(abs(-16))")["result"] == 4
    for bad in ("2 ** 21", "__import__('os')", "1 +", "1 / 0", "(-8) ** 0.5", None, "a"):
        assert evaluate(bad)["success"] is False
    rows = spark.createDataFrame([("1 + 1",), (None,)], "e string").select(calculate("e").alias("r")).collect()
    assert rows[0].r.result == 2.0 and rows[1].r.success is False


def test_stems():
    for word, want in [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("motoring", "motor"), ("agreed", "agre"), ("happy", "happi"), ("rate", "rate"), ("controlling", "control")]:
        assert stem(word) == want
    assert analyze("The dividends of banks", "english") == [None, "dividend", None, "bank"]


def brute_covers(tokens, words):
    spans = [(i, j) for i in range(len(tokens)) for j in range(i, len(tokens)) if set(words) <= set(tokens[i : j + 1])]
    minimal = [(i, j) for i, j in spans if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans)]
    return sum(0.1 / (1 + sum(t not in words for t in tokens[i : j + 1])) for i, j in minimal)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("abcx"), max_size=14), st.sampled_from([["a"], ["a", "b"], ["a", "b", "c"]]))
def test_cover_density_is_the_sum_over_minimal_covers(spark, tokens, words):
    column = F.array(*map(F.lit, tokens)).cast("array<string>")
    assert one(spark, cover_density(column, words)) == pytest.approx(brute_covers(tokens, words))


def test_query_language(spark):
    hit = lambda q, t: one(spark, matches(simple_tokens(F.lit(t)), parse_query(q)))
    assert hit("net profit", "profit is net") and not hit('"net profit"', "profit is net") and hit('"net profit"', "the Net profit")
    assert hit("loss or profit", "a profit") and not hit("profit -loss", "profit and loss") and not hit("...", "x")
    assert query_words(parse_query('a "b c" -d or e')) == ["a", "b", "c", "e"]


def test_target_counts():
    assert sum(target_counts(103).values()) == 103 and sum(target_counts(1).values()) == 1
    with pytest.raises(ValueError):
        target_counts(5, {"a": 0.0})


words_st = st.lists(st.sampled_from(["alpha", "beta.", "gamma", "delta!"]), min_size=1, max_size=60).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words_st, st.integers(1, 5), st.sampled_from([None, "S", "T"]), st.booleans()), max_size=12))
def test_chunks(paragraphs):
    chunks = pack(("r", "t", 2024), paragraphs, target=40, least=8, overlap=5)
    assert [c["chunk_index"] for c in chunks] == list(range(1, len(chunks) + 1))
    assert len({c["chunk_id"] for c in chunks}) == len(chunks)
    assert all(c["word_count"] <= 40 for c in chunks[:-1]) and all(c["word_count"] >= 8 for c in chunks)
    assert all(c["pdf_page_start"] <= c["pdf_page_end"] for c in chunks)


def test_pack_sentences_keeps_words():
    text = "One two three. Four five! " * 5
    assert " ".join(pack_sentences(text, 7)).split() == text.split()
    assert [len(x.split()) for x in pack_sentences("w " * 9, 4)] == [4, 4, 1]
