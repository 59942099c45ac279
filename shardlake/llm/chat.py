"""Preference formatting: a shared prompt and two masked completions, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _mask(turns: Column) -> Column:
    """One run `length:flag` per turn; flag 1 (assistant) takes part in the loss."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(_turn(t)).cast("string"), F.when(t["role"].eqNullSafe("assistant"), ":1").otherwise(":0"))), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Turns that both conversations begin with: the first position that differs bounds the prefix."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(n).cast("long")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Add prompt, prefix_turns and both completions with masks to rows holding two arrays of (role, text).

    Null arrays count as empty; a null role renders as `unknown`, a null text as empty. Equal
    conversations give empty completions. Rows are independent, so repeated rows stay repeated.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    df = pairs.withColumn("_a", F.coalesce(F.col(chosen), none)).withColumn("_b", F.coalesce(F.col(rejected), none))
    df = df.withColumn("prefix_turns", common_prefix(F.col("_a"), F.col("_b")))
    n = F.col("prefix_turns").cast("int")
    rest = {k: F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0))) for k, c in (("chosen", "_a"), ("rejected", "_b"))}
    df = df.withColumn("prompt", _render(F.slice(F.col("_a"), F.lit(1), n)))
    for k, v in rest.items():
        df = df.withColumn(f"{k}_completion", _render(v)).withColumn(f"{k}_mask", _mask(v))
    return df.drop("_a", "_b", *{chosen, rejected})


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """Chosen: each conversation. Rejected: the same turns, its last assistant turn answered by its partner.

    Partners are the conversations 2k and 2k + 1, so that no popular turn makes a hot key. Without
    a partner that has an assistant turn, or without an own one, the rejected one lacks the last turn.
    Rows without conv_id form one conversation each.
    """
    c = conversations.select("conv_id", F.col("turn").alias("_t"), F.struct("role", "text").alias("_x"))
    whole = c.filter("conv_id is not null").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_x"))), lambda s: s["_x"]).alias("chosen"))
    single = c.filter("conv_id is null").select("conv_id", F.array("_x").alias("chosen"))
    whole = whole.unionByName(single).withColumn("_last", F.try_element_at(F.filter("chosen", lambda t: t["role"].eqNullSafe("assistant")), F.lit(-1)))
    other = whole.filter("conv_id is not null").select(F.expr("conv_id ^ 1L").alias("_partner"), F.col("_last").alias("_reply"))
    df = whole.join(other, whole["conv_id"] == other["_partner"], "left")
    size = F.size("chosen")
    ends = F.try_element_at("chosen", F.lit(-1))["role"].eqNullSafe("assistant")
    head = F.when(ends | F.col("_last").isNull(), F.slice("chosen", F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(F.col("chosen"))
    tail = F.when(F.col("_reply").isNotNull(), F.array("_reply")).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return df.select("conv_id", "chosen", F.concat(head, tail).alias("rejected"))


def op1(conversations: DataFrame) -> DataFrame:
    return format_preferences(preference_pairs(conversations))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS r, role, text,
        '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS s FROM conversations),
w AS (SELECT conv_id, list({'r': role, 't': text, 's': s} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS a FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
    UNION ALL SELECT conv_id, [{'r': role, 't': text, 's': s}] FROM t WHERE conv_id IS NULL),
l AS (SELECT conv_id, a, list_filter(a, lambda x: x.r = 'assistant')[-1] AS last FROM w),
p AS (SELECT x.conv_id, x.a, CASE WHEN x.a[-1].r = 'assistant' OR x.last IS NULL THEN x.a[1:len(x.a) - 1] ELSE x.a END
        || CASE WHEN y.last IS NULL THEN [] ELSE [y.last] END AS b
    FROM l x LEFT JOIN l y ON xor(x.conv_id, 1::BIGINT) = y.conv_id),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i].s IS DISTINCT FROM b[i].s OR a[i].r IS DISTINCT FROM b[i].r OR a[i].t IS DISTINCT FROM b[i].t)) - 1, least(len(a), len(b))) AS k FROM p)
SELECT conv_id, k::BIGINT AS prefix_turns, coalesce(array_to_string(list_transform(a[1:k], lambda x: x.s), ''), '') AS prompt,
    coalesce(array_to_string(list_transform(a[k + 1:], lambda x: x.s), ''), '') AS chosen_completion,
    coalesce(array_to_string(list_transform(a[k + 1:], lambda x: length(x.s)::VARCHAR || CASE WHEN x.r = 'assistant' THEN ':1' ELSE ':0' END), ','), '') AS chosen_mask,
    coalesce(array_to_string(list_transform(b[k + 1:], lambda x: x.s), ''), '') AS rejected_completion,
    coalesce(array_to_string(list_transform(b[k + 1:], lambda x: length(x.s)::VARCHAR || CASE WHEN x.r = 'assistant' THEN ':1' ELSE ':0' END), ','), '') AS rejected_mask
FROM n
"""
