"""Numbers: cosine, rank fusion, retrieval metrics, costs, growth, money, geometry, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
# Dollars for a million input and output tokens.
PRICES = {"gemini-2.5-flash": (0.30, 2.50), "gemini-2.5-flash-lite": (0.10, 0.40), "gemini-3.1-flash-lite": (0.25, 1.50)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank term, 0 where the list lacks the document."""
    return F.coalesce(F.lit(1.0) / (k + rank), F.lit(0.0))


def precision_at(ranked: Column, gold: Column, k: int) -> Column:
    """Share of the returned documents (at most k) that are relevant; repeats count."""
    top = F.slice(ranked, 1, k)
    return F.coalesce(F.size(F.filter(top, lambda x: F.array_contains(gold, x))) / F.nullif(F.size(top), F.lit(0)), F.lit(0.0))


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.coalesce(F.size(F.array_intersect(F.slice(ranked, 1, k), gold)) / F.nullif(F.size(F.array_distinct(gold)), F.lit(0)), F.lit(0.0))


def hit_at(ranked: Column, gold: Column, k: int) -> Column:
    return (F.size(F.array_intersect(F.slice(ranked, 1, k), gold)) > 0).cast("double")


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    """1 over the place of the first relevant document in the whole list."""
    places = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def _gain(place: Column) -> Column:
    return 1 / F.log2(place + 2)


def ndcg_at(ranked: Column, gold: Column, k: int) -> Column:
    """Binary gains; the ideal has min(relevant, k) hits; repeats of a relevant document count again."""
    gains = F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(gold, x), _gain(i)).otherwise(0.0))
    total = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    n = F.least(F.size(F.array_distinct(gold)), F.lit(k))
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)), F.lit(0.0), lambda s, i: s + _gain(i))
    return F.coalesce(total / F.nullif(ideal, F.lit(0.0)), F.lit(0.0))


def retrieval_metrics(ranked: Column, gold: Column, k: int) -> list[Column]:
    return [
        precision_at(ranked, gold, k).alias("precision_at_k"), recall_at(ranked, gold, k).alias("recall_at_k"), hit_at(ranked, gold, k).alias("hit_rate_at_k"),
        reciprocal_rank(ranked, gold).alias("mrr"), ndcg_at(ranked, gold, k).alias("ndcg_at_k"),
    ]


def token_f1(prediction: Column, reference: Column) -> Column:
    """Harmonic mean of precision and recall over the two multisets of tokens (arrays); both empty: 1, one empty: 0."""
    # each token with its number among its like, told from the sorted array, so that the two multisets meet as sets
    def numbered(tokens: Column) -> Column:
        step = lambda s, x: F.struct(F.when(s["t"].eqNullSafe(x), s["n"] + 1).otherwise(1).alias("n"), x.alias("t"), F.concat(s["out"], F.array(F.concat(x, F.lit("\x00"), F.when(s["t"].eqNullSafe(x), s["n"] + 1).otherwise(1).cast("string")))).alias("out"))
        start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("t"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.array_sort(tokens), start, step, lambda s: s["out"])

    common = F.size(F.array_intersect(numbered(prediction), numbered(reference)))
    p, r = F.size(prediction), F.size(reference)
    return F.when((p == 0) & (r == 0), 1.0).when((p == 0) | (r == 0) | (common == 0), 0.0).otherwise(2.0 * common / (p + r))


def tool_success_rate(calls: Column) -> Column:
    """Share of tool calls (structs with ``success``) that did not fail; a missing flag counts as success, no calls as 1."""
    return F.coalesce(F.size(F.filter(calls, lambda c: F.coalesce(c["success"], F.lit(True)))) / F.nullif(F.size(calls), F.lit(0)), F.lit(1.0))


def tool_f1(used: Column, expected: Column) -> Column:
    """Over sets of tool names; null without expected tools."""
    u, e = F.array_distinct(used), F.array_distinct(expected)
    return F.when(F.size(e) > 0, 2.0 * F.size(F.array_intersect(u, e)) / (F.size(u) + F.size(e)))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, thinking: Column) -> Column:
    """Dollars; thinking tokens cost as output, an unknown model nothing."""
    a = b = F.lit(None).cast("double")
    for name, (price_in, price_out) in PRICES.items():
        a, b = F.when(model == name, price_in).otherwise(a), F.when(model == name, price_out).otherwise(b)
    zero = F.lit(0)
    cost = F.coalesce(tokens_in, zero) / F.lit(1e6) * a + (F.coalesce(tokens_out, zero) + F.coalesce(thinking, zero)) / F.lit(1e6) * b
    return F.coalesce(cost, F.lit(0.0))


def growth(current: Column, previous: Column) -> Column:
    """Change in percent of the previous amount; null from 0."""
    return F.when(previous != 0, (current - previous) / F.abs(previous) * 100)


def money(value: Column, unit: Column) -> Column:
    """Short form by unit, e.g. ``₦17.76tn``."""
    f = lambda p, x: F.format_string(p, x)
    return (
        F.when((unit == "ngn_billion") & (F.abs(value) >= 1000), f("₦%,.2ftn", value / 1000))
        .when(unit == "ngn_billion", f("₦%,.1fbn", value)).when(unit == "ngn_per_share", f("₦%,.2f", value))
        .when(unit == "percent", f("%,.1f%%", value)).otherwise(f("%,.2f", value))
    )


def signed_percent(value: Column) -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.format_string("%+.1f%%", value)), F.lit("N/A"))


def token_estimate(text: Column) -> Column:
    """One token for four characters, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def sampled(key: Column, rate: float) -> Column:
    """Whether the first 32 bits of the key's SHA-256, as a share of all, lie below the rate."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0 < min(1.0, max(0.0, rate))


def overlap_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))


def overlap_share(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Share of rectangle a that b covers."""
    area = F.greatest(F.lit(0.0), ax1 - ax0) * F.greatest(F.lit(0.0), ay1 - ay0)
    return F.coalesce(overlap_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) / F.nullif(area, F.lit(0.0)), F.lit(0.0))


def same_column(ax0, ax1, bx0, bx1, least: float = 0.45) -> Column:
    """Whether two blocks overlap sideways by enough of the narrower."""
    narrow = F.least(ax1 - ax0, bx1 - bx0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) / F.when(narrow > 0, narrow) >= least, F.lit(False))


def chunk_id(report: Column, index: Column, text: Column) -> Column:
    return F.concat(report, F.lit("_chunk_"), F.lpad(index.cast("string"), 5, "0"), F.lit("_"), F.substring(F.sha2(text, 256), 1, 16))


def report_id(ticker: Column, year: Column, stem: Column) -> Column:
    return F.replace(F.lower(F.concat_ws("_", ticker, year.cast("string"), stem)), F.lit(" "), F.lit("_"))
