"""Token ids in bit-packed files.

Format (little-endian). A shard is

* header, 16 bytes: magic ``MRPK``, version u16, bits per id u16, ids per block u32, zero u32
* blocks: ids in ``bits`` bits each, lowest bit first, every block padded to a byte
* block offsets: one u64 a block
* document table: id i64, number of ids u64, id-is-null u8, one column after another
* trailer, 40 bytes: ids u64, documents u64, blocks u64, place of the offsets u64, magic, zero u32

``bits`` is the least that holds the vocabulary. Any range of ids is read
through the offsets of its blocks and unpacked by numpy as a whole.

Shards follow ascending document id (nulls first), one a task of a range
partitioning, under a name that depends on the shard only; a task writes under
a name of its own and renames at the end, so a repeated task leaves one file.
Stores that are not mounted are reached through pyarrow's file systems.

Edge cases: null and empty texts have the end id alone; repeated ids are all
written, ordered by text among themselves; an empty table makes no shard and no
rows; ids must be integers; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import map_arrow, new_path, partitions, read_table, store

MAGIC, BLOCK = b"MRPK", 4096
HEADER, TRAILER = struct.Struct("<4sHHII"), struct.Struct("<QQQQ4sI")
_HIGH = regex.compile("[^\\x00-˿]")
_MEMORY, _LONG = 1_000_000, 48


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, padded to a byte."""
    if bits % 8 == 0 and bits <= 32:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    grid = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & np.uint8(1)
    return np.packbits(grid.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0 and bits <= 32:
        out = np.zeros((count, 4), np.uint8)
        out[:, : bits // 8] = raw[: count * bits // 8].reshape(count, bits // 8)
        return out.view("<u4").ravel()
    grid = np.unpackbits(raw, bitorder="little", count=count * bits).reshape(count, bits)
    return (grid.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class PackedWriter:
    """Writes one shard; holds one block and the document table in memory."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        self.fs, self.path = store(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.bits, self.block = self.fs.open_output_stream(self.own), bits, block
        self.out.write(HEADER.pack(MAGIC, 1, bits, block, 0))
        self.at, self.offsets, self.docs, self.waiting, self.n_waiting, self.n_ids = HEADER.size, [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, end, self.block):
            data = pack(ids[i : min(i + self.block, end)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        ids = np.array([0 if i is None else i for i, _ in self.docs], "<i8")
        for part in (np.array(self.offsets, "<u8"), ids, np.array([n for _, n in self.docs], "<u8"), np.array([i is None for i, _ in self.docs], np.uint8)):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(self.n_ids, len(self.docs), len(self.offsets), self.at, MAGIC, 0))
        self.out.close()
        self.fs.move(self.own, self.path)


class PackedReader:
    """Random access to a shard: ``read(start, count)``, and its documents in order."""

    def __init__(self, path: str):
        fs, name = store(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        magic, _, self.bits, self.block, _ = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        self.n_ids, self.n_docs, blocks, self.end, tail, _ = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{path} is no packed shard")
        foot = self.file.read_at(size - TRAILER.size - self.end, self.end)
        self.offsets = np.append(np.frombuffer(foot, "<u8", blocks), np.uint64(self.end))
        self.ids = np.frombuffer(foot, "<i8", self.n_docs, 8 * blocks)
        self.counts = np.frombuffer(foot, "<u8", self.n_docs, 8 * (blocks + self.n_docs)).astype(np.int64)
        self.nulls = np.frombuffer(foot, np.uint8, self.n_docs, 8 * (blocks + 2 * self.n_docs)).astype(bool)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def read(self, start: int, count: int) -> np.ndarray:
        if count <= 0:
            return np.empty(0, np.uint32)
        b0, b1 = start // self.block, (start + count - 1) // self.block
        lo, hi = int(self.offsets[b0]), int(self.offsets[b1 + 1])
        data = self.file.read_at(hi - lo, lo)
        if self.block * self.bits % 8 == 0:  # only the last block has padding
            ids = unpack(data, self.bits, min((b1 + 1) * self.block, self.n_ids) - b0 * self.block)
        else:
            cut = [int(x) - lo for x in self.offsets[b0 : b1 + 2]]
            ids = np.concatenate([unpack(data[cut[k] : cut[k + 1]], self.bits, min(self.block, self.n_ids - (b0 + k) * self.block)) for k in range(b1 - b0 + 1)])
        return ids[start - b0 * self.block :][:count]

    def documents(self, chunk: int = 1 << 20):
        """(id or None, ids), reading about ``chunk`` ids at a time."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + chunk, "right")) - 1)
            ids, at = self.read(int(self.starts[i]), int(self.starts[j] - self.starts[i])), int(self.starts[i])
            for k in range(i, j):
                yield None if self.nulls[k] else int(self.ids[k]), ids[self.starts[k] - at : self.starts[k + 1] - at]
            i = j


class PieceEncoder:
    """The tokenizers library, asked once for each piece of text that its splitter makes.

    Pieces are encoded independently of each other, so the ids of a text are
    those of its pieces. Texts with characters from U+0300 on, where Unicode
    versions could differ, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        # the splitter's pattern over the characters below U+0300, its classes written out
        low = [chr(c) for c in range(0x300)]
        letter, number = ("".join(re.escape(c) for c in low if unicodedata.category(c)[0] == k) for k in "LN")
        space = "".join(re.escape(c) for c in low if c.isspace() and not "\x1c" <= c <= "\x1f")
        self.pieces = re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.model, self.letters = self.library.model, dict(enumerate(byte_alphabet()))
        self.known: dict[str, bytes] = {}

    def _part(self, text: str) -> bytes:
        if _HIGH.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts, known = self.pieces.findall(text), self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) >= _MEMORY:
            known.clear()
        out = []
        for p in parts:
            if (ids := known.get(p)) is None:
                # the library's model takes a piece as one character a byte
                shown = p.encode().decode("latin-1").translate(self.letters)
                ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
                if len(p) <= _LONG:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._part(text[at : m.start()]) if m.start() > at else b"", np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        if at < len(text):
            out.append(self._part(text[at:] if at else text))
        return np.frombuffer(b"".join(out), "<u4")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_loaded: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def _write(folder: str, path: str | None, end_id: int):
    def run(batches):
        writer = None
        enc = piece_encoder(path or default_path())
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    writer = PackedWriter(f"{folder}/shard-{shard:06d}.ids", bits_for(max(enc.vocabulary, end_id + 1)))
                writer.add(doc_id, np.append(enc.encode(text.as_py()), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]}, pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_packed(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, end_id: int = 2, shards: int | None = None) -> list[dict]:
    """Write shards under ``folder``; returns what each holds, with ``start``, the ids in shards before it.

    The list has one entry a shard, so its size follows the number of tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards or partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    made = sorted(map_arrow(dealt, _write(folder, path, end_id), "shard int, n_docs long, n_ids long").collect())
    out, start = [], 0
    for r in made:
        out.append(r.asDict() | {"start": start})
        start += r["n_ids"]
    return out


def _read(folder: str):
    def run(batches):
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows = PackedReader(f"{folder}/shard-{shard:06d}.ids"), []
                for doc_id, ids in reader.documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_packed(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; one task a shard."""
    schema = "shard int, start long"
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    shards = spark.createDataFrame([(m["shard"], m["start"]) for m in manifest], schema).repartitionByRange(len(manifest), "shard")
    return map_arrow(shards, _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids under the 50k byte file with end id 2, and read the files back."""
    folder = new_path(spark, "packed")
    return read_packed(spark, folder, write_packed(read_table(spark, sf_dir, "documents"), folder))
