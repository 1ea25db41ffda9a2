import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, chat, decontaminate, langid, packed, pii, urlfilter

DOCS = "doc_id long, text string"
ALPHABET = "abcXYZ éÀß İ Σς 漢字ｶﾞ ́​  \x1c\x85\x0b 0١2½ 's'LL n't !?..— 😀👩‍👩 ﬁ Å Å \n\tǄ ſ ŉ ΐ ᾳ"


def fuzz(n, seed=3):
    rng = random.Random(seed)
    low = [c for c in ALPHABET if ord(c) < 0x300]
    texts = ["".join(rng.choice(low if k % 2 else ALPHABET) for _ in range(rng.randint(0, 60))) for k in range(n)]
    return [*texts, "<|endoftext|>".join(["a", "", "b́"]), "<|startoftext|>", "a" * 5000, "ab1" * 2000, ""]


def test_bpe_equals_the_library():
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.BytePairEncoder(bpe.default_path())
    for t in fuzz(3000):
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want, t
        assert own.decode(np.array(want, np.uint32)) == library.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello world", 0), (3, "Hello world", 0), (None, "x", 0)], "doc_id long, text string, ids int")
    got = bpe.encode_documents(df).collect()
    assert [(r.id, r.n_tokens, r.decoded) for r in got] == [(1, 0, ""), (2, 0, ""), (3, 2, "hello</w> world</w>"), (3, 2, "hello</w> world</w>"), (None, 1, "x</w>")]
    empty = hashlib.sha256(b"").hexdigest()
    assert bpe.encoding_digests(df).first()[1:] == (0, empty, empty)
    assert bpe.encode_documents(df.where("false")).count() == 0


def test_piece_encoder_equals_the_library():
    path = packed.default_path()
    library, own = Tokenizer.from_file(path), packed.PieceEncoder(path)
    for t in fuzz(3000):
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 24, 31])
@pytest.mark.parametrize("block", [3, 8, 4096])
def test_packed_round_trip(tmp_path, bits, block):
    rng = np.random.default_rng(bits)
    docs = [(None if i == 3 else i, rng.integers(0, 2**bits, rng.integers(0, 700)).astype(np.uint32)) for i in range(20)]
    w = packed.PackedWriter(str(tmp_path / "s"), bits, block)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    r = packed.PackedReader(str(tmp_path / "s"))
    got = list(r.documents(100))
    assert [i for i, _ in got] == [i for i, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(got, docs))
    whole = np.concatenate([ids for _, ids in docs])
    assert (r.read(17, 500) == whole[17:517]).all() and len(r.read(5, 0)) == 0
    assert packed.bits_for(50257) == 16 and packed.bits_for(2) == 1


def test_packed_files_hold_all_documents_in_order(spark, tmp_path):
    rows = [(9, "b a", 1), (None, "null id", 1), (2, None, 1), (2, "", 1), (5, "héllo wörld 漢字", 1), (7, "x " * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    folder = str(tmp_path / "p")
    manifest = packed.write_packed(df, folder, shards=3)
    got = sorted(packed.read_packed(spark, folder, manifest).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(packed.default_path()), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (i, t, _) in zip(got, order, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert packed.read_packed(spark, folder + "e", packed.write_packed(df.where("false"), folder + "e")).count() == 0


def test_language_id_on_held_out_documents(spark, sf_dir):
    rows = langid.op5_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_id_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !", None), (4, "the cat", "en"), (5, "der hund", "de"), (6, "the hat", None), (7, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(5))
    got = {r.row.doc_id: r for r in langid.identify(df, langid.learn(df)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "en", "de", "en"] and got[7].lang_pred in ("en", "de") and got[4].row.score == 5
    none = langid.learn(df.where("false"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_language_id_tells_letters_of_other_scripts():
    """Letters beyond Latin keep apart: no two of a script, and no two scripts, give the same symbols."""
    seen = {}
    for a, b in ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x3041, 0x3096), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x20400)):
        for cp in range(a, b + 1):
            if chr(cp).isalpha() and chr(cp).lower() == chr(cp):
                key = tuple(langid.letters(chr(cp)).tolist())
                assert key not in seen, (cp, seen[key])
                seen[key] = cp
    assert langid.letters("aя漢b").tolist()[0] == 0 and len(langid.letters("aя漢b")) == 2 + 2 + 4


def test_bundles_and_cosines_in_plain_python():
    """Sums of bound letter vectors, made one trigram at a time; letters without a common trigram are nearly at right angles."""
    model = langid.Profiles(256, 3)
    for text in ("the Cat sat", "это 漢字 and 한국어", "a" * 50 + " b漢" * 9, "\U00020001\U00020002 x"):
        s = langid.letters(text).tolist()
        want = np.zeros(256)
        for a, b, c in zip(s, s[1:], s[2:]):
            want += np.roll(model.parts[2][a], 2).astype(int) * np.roll(model.parts[2][b], 1) * model.parts[2][c]
        for _ in range(2):  # made anew, then from the table
            got = model.vector(text)
            assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5)
    one, two = ("".join(chr(k + i) for i in range(0, 120, 2)) for k in (0x4E00, 0x5E00))
    assert abs(float(langid.Profiles().vector(one) @ langid.Profiles().vector(two))) < 0.2
    small = langid.Profiles(64, 1)
    small.used = langid._TABLE_ROWS - 1  # the table is full: it is emptied and filled again
    assert np.allclose(small.vector("漢字 the"), langid.Profiles(64, 1).vector("漢字 the"))


def test_language_id_on_scripts_with_ties_and_repeats(spark):
    train = [("αυτο ειναι ενα κειμενο", "el"), ("это простой текст на русском", "ru"), ("זה טקסט פשוט בעברית", "he"), ("the plain text is here", "en")]
    rows = [(i, t, g) for i, (t, g) in enumerate(train)] + [(None, "это текст", None), (9, "ενα κειμενο", None), (9, "ενα κειμενο", None), (8, "text " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.row.doc_id, r.lang_pred) for r in langid.identify(df, langid.learn(df)).collect()]
    assert got == [(0, "el"), (1, "ru"), (2, "he"), (3, "en"), (None, "ru"), (9, "el"), (9, "el"), (8, "en")]


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    keep = [lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return [[m.span() for m in re.finditer(p, t) if ok(m)] for p, ok in zip(BASE, keep)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for letters, size in (("ab1.2@-+ ()9%_A4", 60), ("a1@.-", 14), ("0123456789 -", 40)):
        for _ in range(8000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, size)))
            assert pii.base_spans(t) == plain_spans(t), t


def test_pii_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de now"), (4, "é 4111 1111 1111 1111 and +1 (487) 555-7209"), (5, "1.2.3.4 300.1.1.1"), (6, "clean words")]
    got = {r.id: r for r in pii.find_personal_data(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")).collect()}
    assert got[3].spans == "email:5:13" and got[4].n_card == 1 and got[4].n_phone == 1 and got[5].n_ip == 1
    assert got[1].spans == got[2].spans == got[6].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].base_sha256 == hashlib.sha256(b"ip:0:7").hexdigest()
    assert pii.find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


def test_added_spans_against_planted_ones(spark):
    """Looser written forms among look-alikes: figures of what the method adds to the base spans."""
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    plant = {
        "email": lambda: f"mail to {name()} (at) {name()}.{rng.choice(['com', 'de', 'org'])} please", "phone": lambda: f"call ({number(3)}) {number(3)}-{number(4)} today",
    }
    noise = [lambda: f"version {number(2)}.{number(3)} of part {number(5)}", lambda: f"in {number(4)} there were {number(3)} of them", lambda: f"token {number(16)} and id {number(12)}"]
    rows, want = [], {}
    for i in range(900):
        kind = rng.choice([*plant, None])
        rows.append((i, plant[kind]() if kind else rng.choice(noise)()))
        want[i] = kind
    rows += [(1000 + i, f"write {name()}@{name()}.com or call +1 ({number(3)}) {number(3)}-{number(4)}") for i in range(300)]  # base spans teach the labelers
    got = {r.id: r for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    said = {i: {s.split(":")[0] for s in got[i].spans.split(",") if s} for i in want}
    right = sum(k is not None and k in said[i] for i, k in want.items())
    wrong = sum(bool(said[i]) for i, k in want.items() if k is None)
    recall, precision = right / sum(k is not None for k in want.values()), right / max(1, right + wrong)
    print("added spans: recall", round(recall, 3), "precision", round(precision, 3))
    assert recall >= 0.8 and precision >= 0.9
    assert all(got[i].n_spans == len([s for s in got[i].spans.split(",") if s]) for i in got)


def test_em_follows_the_labelers():
    votes = [(1, 1, 1), (1, 1, 0), (-1, -1, -1), (-1, -1, 0), (1, -1, 0)]
    code = np.array([pii._code(0, v, "a.b@c.de") for v in votes])
    p = pii.estimate(code, np.array([50, 40, 60, 50, 5]))
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < 0.1 and p[3] < 0.1


URLS = [("https://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://net/", "net", "/", "net/", "block"), ("http://x.net", "x.net", "", None, None), ("x://y.org/fr/1", "y.org", "/fr/1", "org/fr/", "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://example.com/de/?x", "example.com", "/de/", "example.com/de/", "block"), (None, "", "", None, None), ("no scheme/net/", "", "", None, None), ("a://B#c/d", "b", "", None, None)]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.id: r for r in urlfilter.filter_urls(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert {r.verdict for r in urlfilter.filter_urls(df, rules=[]).collect()} == {"allow"}
    assert urlfilter.filter_urls(df.where("false")).count() == 0


def test_url_model_tells_the_sides(spark):
    good, bad = [f"http://news{i}.org/story/{i}" for i in range(300)], [f"http://x{i}.biz/win-cash?{i}" for i in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad)], "page_id long, url string")
    labels = df.select(F.col("page_id").alias("id"), "url", (F.col("page_id") < 300).cast("int").alias("side"))
    new = spark.createDataFrame([(1, "http://news999.org/story/77"), (2, "http://x777.biz/win-cash?9")], "page_id long, url string")
    assert {r.id: r.verdict for r in urlfilter.filter_urls(new, rules=[], labelled=labels).collect()} == {1: "allow", 2: "block"}


def test_decontamination_rows(spark):
    item = " ".join(f"w{k}" for k in range(20))
    items = spark.createDataFrame([(1, item), (2, "Tiny item"), (3, None), (4, ""), (5, "tiny ITEM"), (None, "w1 w2")], "item_id long, text string")
    docs = [(1, "x " * 5 + item.upper() + "."), (2, "a tiny, item a tiny item"), (3, None), (4, ""), (5, " ".join(f"w{k}" for k in range(12))), (6, "é " * 500 + item), (6, "é " * 500 + item), (None, "tiny item")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int")
    got = sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, items).collect()), key=str)
    want = [(1, 25, 20, ["1"]), (2, 6, 4, ["2", "5"]), (3, 0, 0, []), (4, 0, 0, []), (5, 12, 0, []), (6, 520, 20, ["1"]), (6, 520, 20, ["1"]), (None, 2, 2, ["2", "5"])]
    assert got == sorted(want, key=str)
    assert decontaminate.contamination(df, items.where("false")).where("n_hit > 0").count() == 0 and decontaminate.contamination(df.where("false"), items).count() == 0


def test_decontamination_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    want = decontaminate.op2_decontaminate(spark, sf_dir).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(decontaminate.op2_decontaminate(spark, sf_dir).collect()) == sorted(want)


def test_preferences(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "good <|im_end|>"), (2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 2, "assistant", "bad"), (2, 3, None, None), (3, 0, "user", "alone"), (None, 0, "user", "x")]
    pairs = spark.createDataFrame([(7, 1, 2), (8, 3, 9), (9, 1, 1), (10, None, 1)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, side int"), pairs).collect()}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    a = got[7]
    assert a.n_prefix == 2 and a.prompt == show("system", "s") + show("user", "hi")
    assert a.chosen == show("assistant", "good < |im_end|>") and a.rejected == show("assistant", "bad") + show("", "")
    assert [a.chosen[m.start : m.end] for m in a.chosen_mask] == ["good < |im_end|><|im_end|>"] and [a.rejected[m.start : m.end] for m in a.rejected_mask] == ["bad<|im_end|>"]
    assert got[8].prompt == "" and got[8].rejected == "" and got[9].chosen == "" and 10 not in got


def test_vocabularies_are_not_in_the_repository():
    from pathlib import Path

    assert not list(Path(bpe.__file__).parents[2].rglob("*.tiktoken")) and public_tokenizers.path("x")
