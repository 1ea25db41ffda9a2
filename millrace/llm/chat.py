"""Preference formatting: shared prompt and masked completions of two conversations.

Method. A pair names a chosen and a rejected conversation. Their longest common
prefix of turns (equal role and text) is rendered once as the prompt; what is
left of each is its completion, with the spans (code points, end exclusive) of
assistant turns, the only ones that carry loss. A turn is rendered as
``<|im_start|>role\\ntext<|im_end|>\\n``; these markers inside a text are broken by
a blank, so a text cannot open or close a turn. Only DataFrame functions are used.

Turns carry their pair and side through one shuffle on the pair (its id and both
members); a task holds the turns of single pairs only.

Edge cases: null role or text counts as empty; turns are ordered by turn (nulls
first), role and text, and repeated rows are repeated turns; rows with null
conv_id are ignored; a conversation whose partner has no turns has an empty
prompt and the partner's completion is empty; equal conversations have empty
completions; pairs with a null member are ignored; repeated pairs count once;
different pairs under one pair_id, null or not, give a row each; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table



def format_preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prefix, n_chosen, n_rejected, prompt, chosen, chosen_mask, rejected, rejected_mask).

    ``conversations``: conv_id, turn, role, text. ``pairs``: pair_id, chosen_id, rejected_id.
    """
    sides = pairs.where("chosen_id is not null and rejected_id is not null").select("pair_id", "chosen_id", "rejected_id").distinct().select(
        "pair_id", "chosen_id", "rejected_id",
        F.explode(F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit(0).alias("side")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit(1).alias("side")))).alias("s"),
    ).select("pair_id", "chosen_id", "rejected_id", "s.conv_id", "s.side")
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.join(sides, "conv_id").groupBy("pair_id", "chosen_id", "rejected_id").agg(F.sort_array(F.collect_list(F.struct("side", "turn", "role", "text"))).alias("all"))
    kind = "array<struct<role:string,text:string>>"
    side = "cast(transform(filter(all, x -> x.side = {}), x -> struct(x.role, x.text)) as " + kind + ")"
    both = rows.select("pair_id", F.expr(side.format(0)).alias("c"), F.expr(side.format(1)).alias("r"))
    # the first turn that differs, or the end of the shorter one
    both = both.withColumn("n_prefix", F.expr("coalesce(nullif(array_position(zip_with(c, r, (x, y) -> x <=> y), false), 0) - 1, cast(size(c) as long))"))
    both = both.withColumn("n_prefix", F.least("n_prefix", F.size("c"), F.size("r")).cast("int"))

    def shown(name: str) -> str:
        """Rendered turns; turns are compared as they are, and markers are broken only here."""
        safe = r"regexp_replace(x.{}, r'<\|(im_start|im_end)\|>', '< |$1|>')"
        name = f"transform({name}, x -> struct({safe.format('role')} as role, {safe.format('text')} as text))"
        return f"transform({name}, x -> struct(x.role = 'assistant' as loss, concat('<|im_start|>', x.role, '\\n', x.text, '<|im_end|>\\n') as s, length(x.role) + 13 as head))"

    parts = both.select(
        "pair_id", "n_prefix", F.size("c").alias("n_chosen"), F.size("r").alias("n_rejected"),
        F.expr(shown("slice(c, 1, n_prefix)")).alias("p"),
        F.expr(shown("slice(c, n_prefix + 1, size(c))")).alias("c"), F.expr(shown("slice(r, n_prefix + 1, size(r))")).alias("r"),
    )

    def mask(name: str) -> str:
        """Spans from the text of assistant turns to their end marker, which is to be learned too."""
        empty = "cast(array() as array<struct<start:int,end:int>>)"
        return (
            f"aggregate({name}, struct(0 as at, {empty} as spans), (a, x) -> struct(a.at + length(x.s) as at, "
            f"if(x.loss, concat(a.spans, array(struct(a.at + x.head as start, a.at + length(x.s) - 1 as end))), a.spans) as spans), a -> a.spans)"
        )

    join = "array_join(transform({0}, x -> x.s), '')"
    return parts.select(
        "pair_id", "n_prefix", "n_chosen", "n_rejected", F.expr(join.format("p")).alias("prompt"),
        F.expr(join.format("c")).alias("chosen"), F.expr(mask("c")).alias("chosen_mask"),
        F.expr(join.format("r")).alias("rejected"), F.expr(mask("r")).alias("rejected_mask"),
    )


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as preference examples, texts as digests."""
    turns = read_table(spark, sf_dir, "conversations")
    pairs = turns.where("conv_id is not null").select(F.expr("floor(conv_id / 2)").cast("long").alias("pair_id")).distinct()
    pairs = pairs.select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))
    out = format_preferences(turns, pairs)

    def spans(name: str):
        return F.expr(f"array_join(transform({name}, x -> concat(x.start, '-', x.end)), ',')").alias(name)

    return out.select(
        "pair_id", "n_prefix", "n_chosen", "n_rejected", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen", 256).alias("chosen_sha256"), spans("chosen_mask"),
        F.sha2("rejected", 256).alias("rejected_sha256"), spans("rejected_mask"),
    )


OP6_SQL = r"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, turn,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), g AS (
  SELECT pair_id, coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 0), []) AS c,
    coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 1), []) AS r FROM t GROUP BY pair_id
), n AS (
  SELECT *, CAST(len(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[1:i] = r[1:i])) AS INTEGER) AS n_prefix FROM g
), x AS (
  SELECT pair_id, n_prefix, list_transform(c, lambda x: {'role': regexp_replace(x.role, '<\|(im_start|im_end)\|>', '< |\1|>', 'g'), 'text': regexp_replace(x.text, '<\|(im_start|im_end)\|>', '< |\1|>', 'g')}) AS c,
    list_transform(r, lambda x: {'role': regexp_replace(x.role, '<\|(im_start|im_end)\|>', '< |\1|>', 'g'), 'text': regexp_replace(x.text, '<\|(im_start|im_end)\|>', '< |\1|>', 'g')}) AS r FROM n
), s AS (
  SELECT pair_id, n_prefix, CAST(len(c) AS INTEGER) AS n_chosen, CAST(len(r) AS INTEGER) AS n_rejected, c[1:n_prefix] AS p, c[n_prefix + 1 :] AS c, r[n_prefix + 1 :] AS r FROM x
), q AS (
  SELECT *, list_transform(c, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS cs,
    list_transform(r, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS rs,
    list_transform(p, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS ps FROM s
)
SELECT pair_id, n_prefix, n_chosen, n_rejected,
  sha256(coalesce(array_to_string(ps, ''), '')) AS prompt_sha256, sha256(coalesce(array_to_string(cs, ''), '')) AS chosen_sha256,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
    CAST(coalesce(length(array_to_string(cs[1 : i - 1], '')), 0) + length(c[i].role) + 13 AS VARCHAR) || '-' || CAST(length(array_to_string(cs[1:i], '')) - 1 AS VARCHAR)), ','), '') AS chosen_mask,
  sha256(coalesce(array_to_string(rs, ''), '')) AS rejected_sha256,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
    CAST(coalesce(length(array_to_string(rs[1 : i - 1], '')), 0) + length(r[i].role) + 13 AS VARCHAR) || '-' || CAST(length(array_to_string(rs[1:i], '')) - 1 AS VARCHAR)), ','), '') AS rejected_mask
FROM q
"""
