"""Connected components over a distributed edge list.

Large-star / small-star rounds: every round is a few aggregations and joins on
node ids, minima are combined before the shuffle, and the edge list is written
to the shared folder between rounds so that a lost executor costs one round.
The result is a star forest; nothing is gathered on the driver but two numbers
a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import forget, small_enough, written

MAX_ROUNDS = 60
#: Members of a block in which a large bucket's members are held against each other.
BLOCK = 1024
#: Buckets with members of several components up to which these are broadcast.
BROADCAST_BUCKETS = 500_000


def _written_edges(df: DataFrame) -> tuple[DataFrame, str, tuple]:
    """``df`` written, and two numbers that tell one edge list from another, taken while writing; xor cannot overflow, and no edge occurs twice."""
    seen = Observation()
    new, path = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return new, path, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node that some edge touches; component is the smallest id reachable.

    ``edges`` may hold both directions, repeats, self-loops and nulls (the last
    two are ignored). Ids are any orderable type. Without edges the result is
    empty.
    """
    spark = edges.sparkSession
    star = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select("u", "v")
        .distinct()
    )
    star, path, before = _written_edges(star)
    if not before[0]:
        return star.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        # large star: hang each larger neighbour of a node on the node's smallest neighbour
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            star.select(F.col("v").alias("n"), F.col("u").alias("far"))
            .join(least.withColumnRenamed("u", "n"), "n")
            .select(F.col("far").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # small star: hang a node and its smaller neighbours on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new, new_path, after = _written_edges(small)
        forget(spark, path)
        star, path = new, new_path
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(a, ta, b, tb): each member of a bucket with the bucket's smallest member; linear in the rows."""
    # tags stay out of the aggregate; the head's comes from its own row, out of the same shuffle (an equality would be made a key of the join)
    heads = buckets.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    met = buckets.join(heads, "key")
    tags = met.where("node <= b").select("key", F.col("tag").alias("tb"))
    return met.where("node > b").join(tags, "key").select(F.col("node").alias("a"), F.col("tag").alias("ta"), "b", "tb").distinct()


def _block_pairs(rest: DataFrame) -> DataFrame:
    """(a, ta, b, tb): members of different components of a bucket, each pair once; no task holds more than two blocks of a bucket at a time."""
    dealt = rest.withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    left = dealt.select("key", F.col("i").alias("lo"), F.explode(F.expr("sequence(i, g - 1)")).alias("hi"), F.col("node").alias("a"), F.col("tag").alias("ta"), F.col("component").alias("ca"))
    right = dealt.select("key", F.col("i").alias("hi"), F.explode(F.expr("sequence(0, i)")).alias("lo"), F.col("node").alias("b"), F.col("tag").alias("tb"), F.col("component").alias("cb"))
    return left.join(right, ["key", "lo", "hi"]).where("ca <> cb and (lo < hi or a < b)").select("a", "ta", "b", "tb")


def link_buckets(buckets: DataFrame, confirm, settle=None, split=None, split_over: int = 64, pairs: DataFrame | None = None, repeats: bool = True) -> DataFrame:
    """(id, component) of the relation that ``confirm`` holds, over nodes that share a bucket.

    ``buckets`` has (key, node, tag), the tag a fact about the node that spares
    ``confirm`` a join; ``confirm`` takes (a, ta, b, tb) and returns the (a, b) that
    are linked. Every member of a bucket is tied to one head only, these ties are
    confirmed, and components are found; a bucket whose members then lie in one
    component can add nothing and goes, and so does each head, which has met all
    members, and of buckets with equal members all but one. In the few buckets left, members of different components are held
    against each other, so that no link is lost: by ``settle``, which takes
    (key, node, tag, component, n), n the members of the bucket, and returns links
    (a, b), or by ``confirm`` over a join in which a bucket goes in blocks of about ``BLOCK`` members, each pair of blocks
    one key; what ``confirm`` asks of the tags first becomes the join's own condition.

    With ``split``, which takes the tag's name and returns an array, members of a
    bucket of over ``split_over`` are tied to a head in smaller buckets, by its
    elements, as well: this spares comparisons, and no pair depends on it.
    ``pairs`` (a, ta, b, tb) are confirmed as well; these are buckets of two.
    ``repeats`` tells whether ``buckets`` may hold a row twice. Nodes without a link
    are not in the result.
    """
    spark = buckets.sparkSession
    live = buckets.select("key", "node", "tag")
    live, live_path = written(live.distinct() if repeats else live, "buckets")
    paths = [live_path]

    def kept(df: DataFrame, name: str) -> DataFrame:
        new, path = written(df, name)
        paths.append(path)
        return new

    ties = live
    if split is not None:
        crowds = kept(live.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_over).select("key"), "crowds")
        if not crowds.isEmpty():
            dealt = live.join(crowds, "key").select(F.xxhash64("key", F.lit(0)).alias("old"), "node", "tag", F.explode(split("tag")).alias("part"))
            ties = live.unionByName(dealt.select(F.xxhash64("old", "part").alias("key"), "node", "tag"))
    met = star_pairs(ties)
    links = kept(confirm(met if pairs is None else met.unionByName(pairs)), "links")
    found = connected_components(links)
    heads = live.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 2")

    def members_of(keys: DataFrame) -> DataFrame:
        """Members but the head of the buckets in ``keys`` (key, head, ...), with their components."""
        return live.join(keys, "key").where("node <> head").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))

    # of buckets with the same members, told by 128 bits, one is enough; the buckets left get numbers
    members = [F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2))]
    mixed = members_of(heads.select("key", "head")).groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("head").alias("head"), *members).where("c0 < c1")
    mixed = mixed.groupBy("n", "x1", "x2").agg(F.min(F.struct("key", "head")).alias("one")).select("one.*", "n", F.monotonically_increasing_id().alias("number"))
    # only the buckets left are joined with components again; their members are counted already
    mixed = kept(mixed, "mixed")
    if small_enough(mixed, BROADCAST_BUCKETS):
        mixed = F.broadcast(mixed)
    rest = kept(members_of(mixed).select(F.col("number").alias("key"), "node", "tag", "component", "n"), "buckets")
    if not rest.isEmpty():
        if settle is not None:
            more = settle(rest)
        else:
            more = confirm(_block_pairs(rest))
        found = connected_components(links.unionByName(kept(more, "links")))
    for path in paths:
        forget(spark, path)
    return found
