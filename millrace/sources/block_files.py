"""A data source for files of layout blocks, one JSON object a line, that fails on no file and no line.

``spark.read.format("block_files").load(folder)``: files are listed once and cut into
byte ranges of about ``splitBytes``; a range holds the lines that begin in it. What
cannot be read comes as a row with ``error``: a line that is no object, a field of a
wrong type, a line that is no UTF-8, a file that is empty or cannot be opened. A row
names its file and the byte at which its line begins. Blank lines are no rows.

Options: ``pattern`` (of file names, ``*.jsonl``), ``splitBytes`` (32 MB).
"""

from __future__ import annotations

import fnmatch
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

#: Name and check of every field.
FIELDS = {"report_id": str, "page_number": int, "block_index": int, "text": str}
SCHEMA = "file string, start long, report_id string, page_number long, block_index long, text string, error string"
SPLIT_BYTES = 32 << 20


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    error: str | None = None


def _store(path: str):
    """(file system, path in it) of a local path or of an address that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def parsed(line: bytes) -> tuple:
    """(report_id, page_number, block_index, text, error) of a line."""
    nothing = (None,) * len(FIELDS)
    try:
        row = json.loads(line.decode())
    except (UnicodeDecodeError, ValueError) as e:
        return (*nothing, f"{type(e).__name__}: not a line of JSON")
    if not isinstance(row, dict):
        return (*nothing, "not an object")
    for name, kind in FIELDS.items():
        v = row.get(name)
        if v is not None and (not isinstance(v, kind) or isinstance(v, bool) or (kind is int and not -(1 << 63) <= v < 1 << 63)):
            return (*nothing, f"{name} is no {kind.__name__}")
    return (*(row.get(n) for n in FIELDS), None)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pattern, self.size = options["path"], options.get("pattern", "*.jsonl"), int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, top = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern))
        out = [Range(p, a, min(a + self.size, n)) for p, n in files for a in range(0, n, self.size)]
        return out + [Range(p, 0, 0, "empty file") for p, n in files if not n] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        blank = (None,) * len(FIELDS)
        if part.error:
            yield (part.path, 0, *blank, part.error)
            return
        store, _ = _store(self.folder)
        try:
            with io.BufferedReader(store.open_input_file(part.path)) as f:
                at = part.begin
                f.seek(max(at - 1, 0))
                if at:  # the line that runs into this range belongs to the one before
                    at += len(f.readline()) - 1
                while at < part.end:
                    line = f.readline()
                    if not line:
                        break
                    if line.strip():
                        yield (part.path, at, *parsed(line))
                    at += len(line)
        except OSError as e:
            yield (part.path, part.begin, *blank, f"{type(e).__name__}: cannot be read")


class BlockFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_blocks(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Rows of ``SCHEMA`` for all block files under ``folder``."""
    ship(spark)
    spark.dataSource.register(BlockFiles)
    return spark.read.format("block_files").options(**{k: str(v) for k, v in options.items()}).load(folder)


def report_counts(rows: DataFrame) -> DataFrame:
    """(report_id, pages, blocks) from the rows that could be read."""
    ok = rows.where("error is null")
    return ok.groupBy("report_id").agg(F.countDistinct("page_number").alias("pages"), F.count(F.lit(1)).alias("blocks"))


def file_errors(rows: DataFrame) -> DataFrame:
    """(file, errors, first): what each file could not give."""
    return rows.where("error is not null").groupBy("file").agg(F.count(F.lit(1)).alias("errors"), F.min_by("error", "start").alias("first"))
