"""URL filter: host and path rules, else the ratio of two character language models.

Method. Rules decide the URLs they cover. For the others, two smoothed
variable-order Markov models of the URL's bytes (orders 0 to 5), one of accepted
and one of rejected URLs, give a log-likelihood each; their difference divided
by the length is compared with a threshold calibrated on a held-out fifth of the
labelled URLs (best balanced accuracy). Each order is smoothed towards the
next lower one with a weight that falls with the context's count, so long
contexts rule where they are known.

Counts come from all labelled URLs, are exact and stay in a distributed table that
grows with the corpus. A place of a URL is its window: the byte and the five
before it, nine bits each in a long. Counts of all orders are sums over windows
with the same end, and what a place adds to the score depends on its window alone, so it is
worked out once for each distinct window and joined with the places. That table
is broadcast up to ``BROADCAST_ROWS`` windows; beyond, only the most common
windows are, and the others are joined in a shuffle. Terms are added as whole
numbers of 2**-32, so that their order does not matter.

Labels are the URLs that rules decide, or any two tables that the caller gives.
Edge cases: a null URL or one without ``://`` has empty host and path, and null
counts as the empty text; without labels of both kinds the verdict is ``allow``;
repeated rows give one row each; null page ids are kept and belong to training;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_arrow, read_table, small_enough, written

ORDER, WEIGHT, STEPS = 5, 4.0, 2000
#: Distinct windows that are broadcast; beyond, those with this share of all places.
BROADCAST_ROWS, COMMON = 500_000, 1e-4
#: Bits of a byte in a window, and the parts of a term's unit.
BITS, UNIT = 9, 1 << 32
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_and_path(url) -> tuple:
    """Columns host and path of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path")


def rule_for(rules: list[tuple[str, str]]) -> object:
    """Struct (rule, verdict) of the longest rule that fits the columns host and path, or null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, tail = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + tail)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _windows(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The window of every place of the URLs, and the URLs' lengths."""
    parts = [u.encode() for u in urls]
    lengths = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = text.copy()
    for k in range(1, ORDER + 1):  # one byte further back; 0 before the start
        back = np.zeros(len(text), np.int64)
        back[k:] = text[:-k]
        back[place < k] = 0
        out |= back << (BITS * k)
    return out, lengths


def _count(batches):
    for batch in batches:
        side = np.array(batch.column(1).to_pylist())
        urls = batch.column(0).to_pylist()
        for s in (-1, 0, 1):
            found, n = np.unique(_windows([u or "" for u, x in zip(urls, side) if x == s])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), s, np.int32)), pa.array(n.astype(np.int64))], ["w", "side", "n"])


def _places(batches):
    for batch in batches:
        found, lengths = _windows([u or "" for u in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(1).to_numpy(), lengths)), pa.array(found)], ["uid", "w"])


def count_windows(urls: DataFrame) -> DataFrame:
    """(w, n, n0, n1) from (url, side) rows: places to score (side -1), places of rejected (0) and accepted (1) URLs."""
    counts = map_arrow(urls.select("url", "side"), _count, "w long, side int, n long")
    return counts.groupBy("w").agg(*(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(c) for s, c in ((-1, "n"), (0, "n0"), (1, "n1"))))


def terms(windows: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """(w, n, term) of the windows to score: log-likelihood of the byte under accepted less that under rejected, in parts of ``UNIT``."""
    small = small_enough(windows, BROADCAST_ROWS)
    known = windows.where("n0 + n1 > 0")
    out = windows.where("n > 0")

    def summed(out: DataFrame, key: str, name: str, bounded: bool) -> DataFrame:
        table = known.groupBy(F.expr(key).alias("k")).agg(F.sum("n0").alias(f"{name}_0"), F.sum("n1").alias(f"{name}_1"))
        if small or bounded or small_enough(table, BROADCAST_ROWS):
            table = F.broadcast(table)
        return out.withColumn("k", F.expr(key)).join(table, "k", "left").drop("k")

    for k in range(ORDER + 1):  # two bytes or fewer have at most 257 ** 2 values
        if k < ORDER:
            out = summed(out, f"w & {(1 << BITS * (k + 1)) - 1}L", f"full{k}", k < 2)
        if k:
            out = summed(out, f"shiftrightunsigned(w, {BITS}) & {(1 << BITS * k) - 1}L", f"head{k}", k < 3)
    logs = []
    for s in (1, 0):
        p = F.lit(1 / 256)
        for k in range(ORDER + 1):
            full = F.coalesce(f"full{k}_{s}", F.lit(0)) if k < ORDER else F.col(f"n{s}")
            head = F.coalesce(f"head{k}_{s}", F.lit(0)) if k else F.lit(totals[s])
            p = (full + WEIGHT * p) / (head + WEIGHT)
        logs.append(F.log(p))
    return out.select("w", "n", F.round((logs[0] - logs[1]) * UNIT).cast("long").alias("term"))


def score(urls: DataFrame, term: DataFrame) -> DataFrame:
    """(uid, sum) from (url, uid) rows: the terms of their places added up, in parts of ``UNIT``; no row for an empty URL."""
    places = map_arrow(urls.select("url", "uid"), _places, "uid long, w long")
    if small_enough(term, BROADCAST_ROWS):
        met = places.join(F.broadcast(term.select("w", "term")), "w")
    else:
        least = COMMON * term.agg(F.sum("n")).first()[0]
        common = F.broadcast(term.where(F.col("n") >= least).select("w", F.col("term").alias("common")))
        both = places.join(common, "w", "left")
        rare = both.where("common is null").select("uid", "w").join(term.where(F.col("n") < least).select("w", "term"), "w")
        met = both.where("common is not null").select("uid", F.col("common").alias("term")).unionByName(rare.select("uid", "term"))
    return met.groupBy("uid").agg(F.sum("term").alias("sum"))


def calibrate(scored: DataFrame) -> float:
    """The threshold of the best balanced accuracy over (score, side) rows, from a histogram of 4000 bins over -10 to 10."""
    bins = scored.select(F.least(F.greatest(F.floor(F.col("score") * 200), F.lit(-STEPS)), F.lit(STEPS)).alias("b"), "side").groupBy("b", "side").count().collect()
    hist = np.zeros((2, 2 * STEPS + 1))
    for r in bins:
        hist[r["side"], r["b"] + STEPS] += r["count"]
    share = hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    below, above = np.concatenate(([0], np.cumsum(share[0]))), np.concatenate((np.cumsum(share[1][::-1])[::-1], [0]))
    best = np.flatnonzero(np.isclose(below + above, (below + above).max()))
    return float((best[len(best) // 2] - STEPS) / 200)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row; score is null where a rule decides.

    ``labelled``: (id, url, side) rows to learn from, side 1 accepted; by default the URLs that rules decide.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parts = rows.select("id", "url", *host_and_path(F.col("url"))).withColumn("r", rule_for(rules))
    if labelled is None:
        labelled = parts.where("r is not null").select("id", "url", (F.col("r.verdict") == "allow").cast("int").alias("side"))
    known = labelled.where("url is not null").withColumn("test", F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)
    p = F.struct("id", "host", "path", "r")
    kind = parts.select(p.alias("p")).schema["p"].dataType
    todo = parts.select("url", p.alias("p"), F.lit(None).cast("int").alias("side")).unionByName(known.where("test").select("url", F.lit(None).cast(kind).alias("p"), "side"))
    todo, _ = written(todo.withColumn("uid", F.monotonically_increasing_id()), "urls")
    counted = count_windows(todo.select("url", F.lit(-1).alias("side")).unionByName(known.where("not test").select("url", "side")))
    windows, windows_path = written(counted, "windows")
    totals = windows.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    if not all(totals):
        judged, threshold = parts.withColumn("score", F.lit(0.0)), 0.0
    else:
        term, term_path = written(terms(windows, totals), "terms")
        sums, _ = written(score(todo, term), "url-sums")
        forget(todo.sparkSession, term_path)
        length = F.greatest(F.octet_length(F.coalesce("url", F.lit(""))), F.lit(1))
        scored = todo.join(sums, "uid", "left").withColumn("score", F.coalesce(F.col("sum") / F.lit(float(UNIT)) / length, F.lit(0.0)))
        threshold = calibrate(scored.where("p is null").select("side", "score"))
        judged = scored.where("p is not null").select("p.*", "score")
    forget(todo.sparkSession, windows_path)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select(
        "id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_model).alias("verdict"),
        F.when(F.col("r").isNull(), F.col("score")).alias("score"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rule or by the language models learned from the URLs that rules decide."""
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).withColumnRenamed("id", "page_id")
