"""The built index: documents by ticker and year, and an inverted index of their lexemes.

Postings carry the document's ticker and year. A search reads the postings of its own
words, filters and scores them without the documents, and then fetches the top-k by
their ids, tickers and years, which prune folders and row groups; no text is split
at query time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Term, cover_density_of, lexemes, parse_query, query_words
from ..shipping import ship
from .search import FIELDS, top_k, with_filters

KEY = ["document_id", "ticker", "report_year"]
POSTINGS = "term string, document_id string, ticker string, report_year int, n long, places array<struct<pos:int,dense:int>>"
#: Tokens of a run of postings, unless one document has more.
RUN_TOKENS = 1_000_000


@dataclass(frozen=True)
class Index:
    """``documents``: the unified rows with embeddings. ``postings``: term, document_id, ticker, report_year, places (pos, dense)."""

    documents: DataFrame
    postings: DataFrame
    analyzer: str = "english"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of runs of documents, each run sorted by term and document."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch["t"]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(sizes):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + RUN_TOKENS, "right")))
            yield _run(batch.slice(start, end - start))
            start = end


def _run(docs: pa.RecordBatch) -> pa.RecordBatch:
    sizes = pc.fill_null(pc.list_value_length(docs["t"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = docs["t"].flatten().dictionary_encode()
    names = words.dictionary
    first = pc.array_sort_indices(names).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[first] = np.arange(len(names))
    by_id = np.empty(len(docs), np.int64)
    by_id[pc.array_sort_indices(docs["document_id"]).to_numpy()] = np.arange(len(docs))
    doc = np.repeat(np.arange(len(docs)), sizes)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = words.indices.is_valid().to_numpy(zero_copy_only=False)
    doc, pos, term = doc[known], pos[known], rank[words.indices.drop_null().to_numpy()]
    lexemes_ = np.bincount(doc, minlength=len(docs))
    dense = np.arange(len(doc)) - np.repeat(np.cumsum(lexemes_) - lexemes_, lexemes_)
    order = np.lexsort((pos, by_id[doc], term))
    doc, pos, term, dense = doc[order], pos[order], term[order], dense[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(new, len(doc))
    places = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (pos, dense)], ["pos", "dense"])
    columns = {"term": names.take(pa.array(first[term[new]])), **{c: docs[c].take(pa.array(doc[new])) for c in KEY}, "n": pa.array(np.diff(ends), pa.int64())}
    return pa.RecordBatch.from_pydict(columns | {"places": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)})


def postings(docs: DataFrame, analyzer: str = "english") -> DataFrame:
    """(term, document_id, ticker, report_year, n, places) for each lexeme of a document.

    ``pos`` counts all tokens, so that stop words keep their room; ``dense`` counts
    lexemes only, which is what a phrase needs. A document's tokens are in one row, so
    nothing is shuffled; rows come in runs that are sorted by term.
    """
    ship(docs.sparkSession)
    tokens = docs.select(*KEY, lexemes(F.col("text"), analyzer).alias("t"))
    return tokens.mapInArrow(_postings, POSTINGS)


def check_counts(narratives: DataFrame, tables: DataFrame, documents: DataFrame) -> dict[str, int]:
    """Counts of the sources and the index; an index that lacks or repeats a document is an error."""
    counts = {
        "narratives": narratives.count(), "tables": tables.count(),
        **documents.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("document_id").alias("ids"), F.count("embedding").alias("embeddings")).first().asDict(),
    }
    if counts["documents"] != counts["narratives"] + counts["tables"] or counts["ids"] != counts["documents"]:
        raise ValueError(f"the index does not hold every document once: {counts}")
    return counts


def check_embeddings(counts: dict[str, int], whole: bool) -> None:
    """With ``whole``, every document must have an embedding."""
    if whole and counts["embeddings"] != counts["documents"]:
        raise ValueError(f"{counts['documents'] - counts['embeddings']} documents have no embedding")


def build_index(narratives: DataFrame, tables: DataFrame, embeddings: DataFrame, path: str, *, analyzer: str = "english", whole: bool = False) -> dict[str, int]:
    """Write documents and postings under ``path``, replacing what is there, and return the checked counts.

    Documents are partitioned by ticker and year, dealt by ranges so that a folder has
    few files, and sorted by id within them; postings are written where their documents
    are read, in runs sorted by term, so that the page statistics of a file lead to a word.
    """
    docs, spark = narratives.unionByName(tables).join(embeddings, "document_id", "left"), narratives.sparkSession
    order = ["ticker", "report_year", "document_id"]
    docs.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("ticker", "report_year").parquet(f"{path}/documents")
    stored = index_documents(spark, path)
    counts = check_counts(narratives, tables, stored)
    check_embeddings(counts, whole)
    postings(stored, analyzer).write.mode("overwrite").parquet(f"{path}/postings")
    return counts | {"postings": index_postings(spark, path).count()}


def index_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents").withColumns({"ticker": F.col("ticker").cast("string"), "report_year": F.col("report_year").cast("int")})


def index_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str, analyzer: str = "english") -> Index:
    return Index(index_documents(spark, path), index_postings(spark, path), analyzer)


def _has(words: Column, t: Term) -> Column:
    """Whether the map of a document's words to their places satisfies a term."""
    first = words[t.words[0]]

    def follows(x: Column, k: int, word: str) -> Column:
        return F.coalesce(F.exists(words[word], lambda y: y["dense"] == x["dense"] + k), F.lit(False))

    def begins(x: Column) -> Column:
        out = F.lit(True)
        for k, word in enumerate(t.words[1:], 1):
            out = out & follows(x, k, word)
        return out

    return first.isNotNull() if len(t.words) == 1 else F.coalesce(F.exists(first, begins), F.lit(False))


def search_index(index: Index, query: str, top_k_: int = 10, *, ticker: str | None = None, report_year: int | None = None) -> DataFrame:
    """Documents that match the query, best cover density first; as ``search.keyword_search``, but from postings.

    A branch of negated terms alone matches nothing here, as no posting names such documents.
    """
    parsed = [b for b in parse_query(query, index.analyzer) if any(not t.negated for t in b)]
    positive = query_words(parsed)
    every = sorted({w for b in parsed for t in b for w in t.words})
    rows = with_filters(index.postings.where(F.col("term").isin(every) if every else F.lit(False)), ticker, report_year)
    hits = rows.groupBy("document_id").agg(F.min("ticker").alias("ticker"), F.min("report_year").alias("report_year"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("words"))
    any_of = F.lit(False)
    for branch in parsed:
        all_of = F.lit(True)
        for t in branch:
            all_of = all_of & (~_has(F.col("words"), t) if t.negated else _has(F.col("words"), t))
        any_of = any_of | all_of
    empty = F.array().cast("array<struct<i:int,k:int>>")

    def numbered(word: str, k: int) -> Column:
        return F.coalesce(F.transform(F.col("words")[word], lambda x: F.struct(x["pos"].alias("i"), F.lit(k).alias("k"))), empty)

    places = F.array_sort(F.concat(empty, *(numbered(w, k) for k, w in enumerate(positive, 1))))
    scored = hits.where(any_of).select("document_id", "ticker", "report_year", F.round(cover_density_of(places, max(1, len(positive))), 9).alias("score"))
    best = top_k(scored, top_k_).collect()  # at most k rows
    spark = index.documents.sparkSession
    ranked = spark.createDataFrame([(r.document_id, r.score, r["rank"]) for r in best], "document_id string, score double, rank int")
    wanted = index.documents.where(F.col("document_id").isin([r.document_id for r in best]) if best else F.lit(False))
    for column in ("ticker", "report_year"):
        values = {r[column] for r in best}
        if values and None not in values:
            wanted = wanted.where(F.col(column).isin(sorted(values)))
    return wanted.join(F.broadcast(ranked), "document_id").select(*FIELDS, "score", "rank")
