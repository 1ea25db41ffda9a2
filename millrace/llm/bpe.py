"""Byte-pair encoding with a priority queue, and decoding.

Method. The symbols of a word form a doubly linked list; a heap holds the merge
rank of each adjacent pair. The lowest rank (leftmost on ties) is merged, its
neighbours' new pairs are pushed, and entries whose symbols have changed since
are skipped as stale: O(n log n) for a word of n symbols. Decoding joins the
vocabulary strings. Words recur, so each task keeps a bounded memory of words it
has merged.

The vocabulary file belongs to a public tokenizer and is read where it lies
(``path`` parameter). What comes before the merges follows the file's
normaliser and splitter. Texts below U+0300 take a short way with the same
result: there, NFC changes nothing and lower-casing goes character by character;
other texts go through the tokenizers library's own normaliser and splitter.

Edge cases: null and empty texts have no ids and decode to the empty text;
strings of special tokens inside a text become the special id, as in the
library; repeated rows give one row each; null document ids are kept; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table

#: From here on the normaliser's Unicode tables matter.
_HIGH = regex.compile("[^\\x00-˿]")
_MEMORY, _LONG = 100_000, 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class BytePairEncoder:
    """Encoder and decoder for a byte-level BPE file with word ends (``end_of_word_suffix``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max(*self.vocab.values(), *self.special.values()))
        for token, i in (self.vocab | self.special).items():
            self.strings[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.letters = byte_alphabet()
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.known: dict[str, bytes] = {}

    def merge(self, symbols: list[str]) -> list[int]:
        """Ids of one word given as byte letters, the last with the word end."""
        ids = [self.vocab[s] for s in symbols]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (m := self.merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := self.merges.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def _word(self, letters: str) -> bytes:
        symbols = list(letters)
        symbols[-1] += self.suffix
        return np.array(self.merge(symbols), "<u4").tobytes()

    def _low(self, text: str) -> bytes:
        known, letters = self.known, self.letters
        parts = self.words.findall(text.lower())
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        out = []
        for p in parts:
            if (ids := known.get(p)) is None:
                ids = self._word("".join([letters[b] for b in p.encode()]))
                if len(p) <= _LONG:
                    if len(known) >= _MEMORY:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def _high(self, text: str) -> bytes:
        parts = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return b"".join([self._word(p) for p, _ in parts if p])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._part(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        out.append(self._part(text[at:] if at else text))
        return np.frombuffer(b"".join(out), "<u4")

    def _part(self, text: str) -> bytes:
        if not text:
            return b""
        return self._high(text) if _HIGH.search(text) else self._low(text)

    def decode(self, ids: np.ndarray) -> str:
        """Vocabulary strings side by side; the file names no decoder, so blanks lie between them."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    if path not in _loaded:
        _loaded[path] = BytePairEncoder(path)
    return _loaded[path]


def _run(path: str | None, decode: bool):
    def run(batches):
        bpe = encoder(path or default_path())
        for batch in batches:
            n, ids, texts = [], [], []
            for text in batch.column(1):
                got = bpe.encode(text.as_py())
                n.append(len(got))
                ids.append(got.astype(np.int32))
                texts.append(bpe.decode(got) if decode else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, decode: bool = True) -> DataFrame:
    """(id, n_tokens, ids, decoded) for every row; ``path`` None takes the 49k word file."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _run(path, decode), f"id {kind}, n_tokens long, ids array<int>, decoded string")


def _digests(path: str | None):
    def run(batches):
        for batch in _run(path, True)(batches):
            ids = [hashlib.sha256(x.values.to_numpy().astype("<u4").tobytes()).hexdigest() for x in batch.column(2)]
            texts = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None) -> DataFrame:
    """As ``encode_documents``, with digests instead of ids and decoded text, which stay in the task."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _digests(path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the 49k word file, and of their decoding, as digests."""
    return encoding_digests(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
