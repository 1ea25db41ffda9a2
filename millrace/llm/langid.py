"""Language identification with hyperdimensional profiles.

Method. Every letter has a fixed random vector of +1 and -1. A trigram is bound
by multiplying its letters' vectors, each rotated by its place; a text is the
sum (bundle) of its trigrams' vectors, and a language prototype the sum of its
training texts' unit vectors, less the mean of all prototypes' directions. A text
gets the language whose prototype has the largest cosine.

Training sums go up in fixed point, so that prototypes do not depend on the
order of tasks. What reaches the driver is languages times dimensions numbers.

Edge cases: null text and text without a letter give ``und`` with score 0; so do
all texts when no labelled text is there to learn from; rows with null language
are predicted but not learned from; repeated rows give one row each; null ids
count as the text ``null`` in the fold rule; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, read_table, ship

DIMENSIONS, SEED, FIXED = 1024, 7, 1 << 20
_TABLE_ROWS, _CHUNK = 16_000, 4096
#: A letter from U+0180 on is two symbols: its block of 128 code points and its place there, so no two letters fall together.
_PLACES = 128
_BLOCKS = 0x110000 // _PLACES


@functools.lru_cache(1)
def _classes() -> tuple[np.ndarray, int]:
    """Letter class by code point below U+0180 (0: no letter), and the first of the classes for letters above."""
    table, n = np.zeros(0x180, np.int64), 0
    for cp in range(0x180):
        if chr(cp).isalpha() and chr(cp).lower() == chr(cp):
            n += 1
            table[cp] = n
    return table, n + 1


def letters(text: str) -> np.ndarray:
    """Letter classes of the text, a single 0 for each run of other characters, and 0 at both ends."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    table, high = _classes()
    low = cps < len(table)
    out = table[np.where(low, cps, 0)]
    if not low.all():
        far = np.unique(cps[~low])
        far = np.isin(cps, far[[chr(cp).isalpha() for cp in far]])
        first = np.cumsum(1 + far) - 1 - far
        out = np.repeat(out, 1 + far)
        out[first[far]] = high + cps[far] // _PLACES
        out[first[far] + 1] = high + _BLOCKS + cps[far] % _PLACES
    out = np.concatenate(([0], out, [0]))
    return out[np.concatenate(([True], (out[1:] > 0) | (out[:-1] > 0)))]


class Profiles:
    """Trigram vectors, made when first met and kept up to a bound."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.low = _classes()[1]
        self.n = self.low + _BLOCKS + _PLACES
        one = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (self.n, dimensions))
        self.parts = [np.roll(one, k, axis=1) for k in (2, 1, 0)]
        self.dimensions = dimensions
        # places in the table: of trigrams of letters below U+0180 in an array, of all others in a dictionary
        self.row, self.far = np.full(self.low**3, -1, np.int32), {}
        self.table, self.used = np.empty((_TABLE_ROWS, dimensions), np.int8), 0

    def _known(self, codes: np.ndarray, base: int) -> np.ndarray:
        if base == self.low:
            return self.row[codes]
        return np.fromiter((self.far.get(c, -1) for c in codes.tolist()), np.int32, len(codes))

    def _rows(self, codes: np.ndarray, base: int) -> np.ndarray:
        """Rows of the table that hold the vectors of distinct trigrams, whose symbols are digits to ``base``."""
        at = self._known(codes, base)
        new = codes[at < 0]
        if len(new):
            if self.used + len(new) > _TABLE_ROWS:
                self.row[:], self.used = -1, 0
                self.far.clear()
                new = codes
            a, b, c = new // (base * base), new // base % base, new % base
            places = np.arange(self.used, self.used + len(new))
            self.table[places] = self.parts[0][a] * self.parts[1][b] * self.parts[2][c]
            if base == self.low:
                self.row[new] = places
            else:
                self.far.update(zip(new.tolist(), places.tolist()))
            self.used += len(new)
            at = self._known(codes, base)
        return at

    def vector(self, text: str | None) -> np.ndarray | None:
        """The text's unit vector; None without a letter."""
        s = letters(text) if text else np.zeros(1, np.int64)
        if len(s) < 3:
            return None
        base = self.low if s.max() < self.low else self.n
        codes, counts = np.unique((s[:-2] * base + s[1:-1]) * base + s[2:], return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(codes), _CHUNK):
            total += counts[i : i + _CHUNK].astype(np.float32) @ self.table[self._rows(codes[i : i + _CHUNK], base)].astype(np.float32)
        size = float(np.sqrt(total @ total))
        return total / size if size else total


_made: dict[tuple, Profiles] = {}


def profiles(dimensions: int, seed: int) -> Profiles:
    if (dimensions, seed) not in _made:
        _made[dimensions, seed] = Profiles(dimensions, seed)
    return _made[dimensions, seed]


def _sums(dimensions: int, seed: int):
    def run(batches):
        model, sums = profiles(dimensions, seed), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                v = model.vector(text.as_py())
                if v is not None:
                    s = sums.setdefault(lang, np.zeros(dimensions, np.int64))
                    s += np.rint(v * FIXED).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "v"])

    return run


def learn(labelled: DataFrame, *, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from (text, lang) rows, all of them."""
    parts = map_arrow(labelled.select("text", "lang").where("lang is not null"), _sums(dimensions, seed), "lang string, v array<long>")
    rows = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["lang"] for r in rows})
    out = np.zeros((len(names), dimensions))
    for r in rows:
        out[names.index(r["lang"]), r["k"]] = r["x"]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    if len(names) > 1:
        out -= out.mean(axis=0)  # what all languages have in common tells nothing
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return names, out.astype(np.float32)


def _predict(names: list[str], prototypes: bytes, dimensions: int, seed: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, protos = profiles(dimensions, seed), np.frombuffer(prototypes, np.float32).reshape(-1, dimensions)
        for batch in batches:
            lang, score = [], []
            for text in batch:
                v = model.vector(text.as_py()) if names else None
                if v is None:
                    lang.append("und")
                    score.append(0.0)
                else:
                    cos = protos @ v
                    k = int(np.argmax(cos))
                    lang.append(names[k])
                    score.append(min(1.0, max(0.0, float(cos[k]))))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", *, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` under ``row``, with lang_pred and score; only the texts go to Python."""
    names, prototypes = model
    ship(docs.sparkSession)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    found = F.arrow_udf(_predict(names, prototypes.tobytes(), dimensions, seed), kind)
    return docs.select(F.struct(*docs.columns).alias("row"), found(F.col(text_col)).alias("found")).select("row", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def held_out(doc_id) -> object:
    """The fold rule: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; prototypes from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs, model).select("row.doc_id", "row.held_out", "lang_pred", "score")
