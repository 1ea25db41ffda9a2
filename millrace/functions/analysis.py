"""Text analysis for keyword search: analyzers, the query language, cover density.

Analyzers: ``simple`` (lower case, split at what is neither letter nor digit) is
a Catalyst expression; ``english`` adds a stop list and Porter's stemmer (Porter
1980) as an Arrow function over arrays of tokens.

Query language: words are joined by AND, ``"a b"`` is a phrase, ``or`` between
terms is OR (binding looser than AND), a leading ``-`` negates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

# Common English function words.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been before being between both but by can could did do does down each few for from "
    "further had has have he her here him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over "
    "own same she should so some such than that the their them then there these they this those through to too under until up very was we were what "
    "when where which while who whom why will with you your".split()
)
COVER_WEIGHT = 0.1


def simple_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """Number of vowel-consonant sequences."""
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# The suffix tables of the published algorithm.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_TABLE2, _TABLE3 = ({k: v for k, _, v in (x.partition(":") for x in t.split(" "))} for t in (_STEP2, _STEP3))


def stem(w: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_TABLE2, _TABLE3):
        for end in sorted((e for e in table if w.endswith(e)), key=len, reverse=True)[:1]:
            if _measure(w[: -len(end)]) > 0:
                w = w[: -len(end)] + table[end]
    for end in sorted((e for e in _STEP4.split(" ") if w.endswith(e)), key=len, reverse=True)[:1]:
        root = w[: -len(end)]
        if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
            w = root
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def analyze(text: str, analyzer: str = "simple") -> list[str | None]:
    """Tokens in order; under ``english`` a stop word leaves a gap (None), so that positions hold."""
    tokens = [t for t in re.split(r"[\W_]+", text.lower()) if t]
    return tokens if analyzer == "simple" else [None if t in STOP_WORDS else stem(t) for t in tokens]


def _english(tokens: pa.Array) -> pa.Array:
    """Each distinct word of a batch is stemmed once; the tokens stay numbers, never objects of their own."""
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([None if w is None or w in STOP_WORDS else stem(w) for w in words.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), stems.take(words.indices), mask=tokens.is_null())


def english_lexemes(tokens: Column) -> Column:
    """Stems of simple tokens, null at stop words."""
    ship(SparkSession.active())
    return F.arrow_udf(_english, T.ArrayType(T.StringType()))(tokens)


def lexemes(text: Column, analyzer: str = "simple") -> Column:
    return simple_tokens(text) if analyzer == "simple" else english_lexemes(simple_tokens(text))


@dataclass(frozen=True)
class Term:
    """Words side by side, or missing if negated."""

    words: tuple[str, ...]
    negated: bool = False


def parse_query(query: str, analyzer: str = "simple") -> list[list[Term]]:
    """OR of ANDs of terms. Terms without a lexeme drop out; an empty list matches nothing."""
    branches: list[list[Term]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            if branches[-1]:
                branches.append([])
            continue
        found = tuple(w for w in analyze(phrase or word, analyzer) if w)
        if found:
            branches[-1].append(Term(found, bool(minus)))
    return [b for b in branches if b]


def matches(tokens: Column, query: list[list[Term]]) -> Column:
    """Whether an array of lexemes satisfies the parsed query."""

    def has(t: Term) -> Column:
        first = F.array_contains(F.filter(tokens, lambda x: x.isNotNull()), t.words[0])
        if len(t.words) == 1:
            return first
        wanted = F.array(*map(F.lit, t.words))
        # phrases skip the gaps that stop words leave
        dense = F.filter(tokens, lambda x: x.isNotNull())
        places = F.transform(dense, lambda _, i: F.slice(dense, i + 1, F.lit(len(t.words))) == wanted)
        return first & F.exists(places, lambda x: x)

    any_of = F.lit(False)
    for branch in query:
        all_of = F.lit(True)
        for t in branch:
            all_of = all_of & (~has(t) if t.negated else has(t))
        any_of = any_of | all_of
    return any_of


def query_words(query: list[list[Term]]) -> list[str]:
    """Words that count for the score."""
    return sorted({w for b in query for t in b if not t.negated for w in t.words})


def cover_density(tokens: Column, words: list[str]) -> Column:
    """Sum over minimal covers of all ``words`` of 0.1 / (1 + other tokens inside).

    A minimal cover is a span with every word and no such span inside it
    (Clarke, Cormack and Tudhope 2000). One pass over the occurrences in order
    keeps the last place of each word; a cover ends at an occurrence if the
    earliest of the last places moved since the cover before.
    """
    if not words:
        return F.lit(0.0)
    places = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.array_position(F.array(*map(F.lit, words)), F.coalesce(t, F.lit(""))).cast("int").alias("k"))), lambda x: x["k"] > 0)
    return cover_density_of(places, len(words))


def cover_density_of(places: Column, n: int) -> Column:
    """Cover density from the places of ``n`` words in order: an array of struct (i: position, k: number of the word from 1)."""
    if n == 1:
        return F.size(places) * COVER_WEIGHT
    # each last place goes with its number among all occurrences, which tells how many lie inside a cover
    none = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("o"))
    start = F.struct(F.array_repeat(none, n).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("score"), F.lit(0).alias("o"))

    def step(a, x):
        last = F.transform(a["last"], lambda v, j: F.when(j == x["k"] - 1, F.struct(x["i"].alias("i"), a["o"].alias("o"))).otherwise(v))
        low = F.array_min(last)
        new = (low["i"] >= 0) & (low["i"] > a["from"])
        noise = (x["i"] - low["i"]) - (a["o"] - low["o"])
        score = a["score"] + F.when(new, COVER_WEIGHT / (1 + noise)).otherwise(0.0)
        return F.struct(last.alias("last"), F.when(new, low["i"]).otherwise(a["from"]).alias("from"), score.alias("score"), (a["o"] + 1).alias("o"))

    return F.aggregate(places, start, step, lambda a: a["score"])
