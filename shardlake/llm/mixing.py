"""Mixing sources to target weights by nested hash-threshold histograms, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, carried, durable

WEIGHTS, SHARE, MAX_REPEAT = (3, 1, 2), 1.5, 2.0
#: A level splits a bucket in 2**BITS; LEVELS of them tell the hashes of 60 bits apart.
BITS, LEVELS = 12, 5
#: Most sources (one row of a few numbers each) of a broadcast table; more are joined by a shuffle.
BROADCAST = 100_000
_BEFORE = (Window.unboundedPreceding, -1)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _running(df: DataFrame, by: list, sums: list[str], within: list[str] = []) -> DataFrame:
    """Add _pos (from 0) and _before_<name> (sums over the rows before), in the order `by` or as the rows lie.

    The rows are sorted over all partitions, numbered inside each, and only one row a partition (and `within` value) is summed up
    in turn, so no task sees them all.
    """
    rows = durable(df.orderBy(*by) if by else df).withColumn("_id", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_id", 33))
    what = [F.lit(1).alias("_pos")] + [F.col(c).alias(f"_before_{c}") for c in sums]
    rows = rows.select("*", *what[1:]).withColumn("_pos", F.lit(1).cast("long"))
    names = ["_pos", *(f"_before_{c}" for c in sums)]
    each = rows.groupBy(*within, "_pid").agg(*[F.sum(c).alias(c) for c in names])
    over = Window.partitionBy(*within).orderBy("_pid").rowsBetween(*_BEFORE)
    start = each.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_pid").alias("_p"), *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_start{c}") for c in names])
    same = F.col("_pid") == F.col("_p")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    inside = Window.partitionBy(*within, "_pid").orderBy("_id").rowsBetween(*_BEFORE)
    rows = rows.select(*[c for c in rows.columns if c not in names], *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in names]).join(_small(durable(start)), same)
    return rows.select(*df.columns, *[(F.col(c) + F.col(f"_start{c}")).alias(c) for c in names])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_REPEAT) -> DataFrame:
    """Target of each source (source, source_size): one row a source.

    Water-filling: sources by rising cap / weight are capped until the level fits; the rest shares by weight. Ranks and running
    sums are made partition by partition. Equal ratios are taken in the order of sources.
    """
    w = _running(sizes.select("source", "source_size"), [F.col("source").isNull(), "source"], []).withColumnRenamed("_pos", "_order")
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_order") % len(weights) + 1).cast("int")))
    w = durable(w.withColumn("_cap", F.lit(float(cap)) * F.col("source_size")))
    total, heavy = w.agg(F.sum("source_size"), F.sum("_w")).first()
    w = _running(w, [F.col("_cap") / F.col("_w"), "_order"], ["_cap", "_w"])
    level = (F.lit(float(share) * (total or 0)) - F.col("_before__cap")) / (F.lit(heavy or 0.0) - F.col("_before__w"))
    w = durable(w.withColumn("_level", level))
    met = w.agg(F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct("_pos", "_level")))).first()[0]
    goal = F.col("_cap") if met is None else F.least(F.col("_cap"), F.lit(met["_level"]) * F.col("_w"))
    return w.select("source", "source_size", goal.alias("target"))


def _measured(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    return docs.drop("source_size", "target", "repeats").withColumn("size", size).withColumn("_h", F.conv(F.substring(key, 1, BITS * LEVELS // 4), 16, 10).cast("long"))


@carried("doc_id", "text", "source")
def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_REPEAT) -> DataFrame:
    """Add size, source_size, target and repeats (0 up to cap, rounded up) to every document; columns of these names are replaced.

    A source's target is met by whole repeats of all its documents, plus the documents whose hash of doc_id
    and text lies under the source's threshold. Histograms of size by source and bucket find the threshold;
    each level refines only the boundary bucket. Rows equal in doc_id and text share the hash: of those at the threshold, as many
    are taken as come nearest (numbered partition by partition; which of them is open unless they differ elsewhere). No document is
    sorted, and the sums have at most 2**BITS rows a source. Null texts and texts without words
    have size 0; null sources form a source. Empty tables give no row.
    """
    rows = _measured(docs)
    return _select(rows, durable(rows.select("source", "size", "_h")), weights, share, cap)


def _select(rows: DataFrame, lean: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """rows: what is returned, measured; lean: their source, size and _h."""
    goal = targets(lean.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("_base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("_need", F.col("target") - F.col("_base") * F.col("source_size")).withColumnRenamed("source", "_s")
    goal = durable(goal.withColumn("_edge", F.lit(0).cast("long")).withColumn("_each", F.lit(0).cast("long")))
    inside = lean
    for level in range(1, LEVELS + 1):
        down = BITS * (LEVELS - level)
        known = _small(goal.filter("_edge is not null").select("_s", "_edge", "_need"))
        same = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", down + BITS) == F.shiftright("_edge", down + BITS))
        inside = inside.select("source", "size", "_h").join(known, same)
        inside = durable(inside) if level > 1 else inside
        hist = inside.groupBy("source", "_need", F.shiftright("_h", down).alias("_b")).agg(F.sum("size").alias("_n"), F.max("size").alias("_one"))
        hist = hist.withColumn("_cum", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")))
        edge = hist.filter(F.col("_cum") > F.col("_need")).groupBy(F.col("source").alias("_es")).agg(F.min(F.struct("_b", "_cum", "_n", "_one")).alias("_e"))
        goal = durable(goal.join(_small(durable(edge)), F.col("_s").eqNullSafe(F.col("_es")), "left").select(
            "_s", "source_size", "target", "_base", F.shiftleft(F.col("_e._b"), down).alias("_edge"), F.coalesce(F.col("_e._one"), F.lit(0)).alias("_each"),
            F.coalesce(F.col("_need") - (F.col("_e._cum") - F.col("_e._n")), F.lit(0.0)).alias("_need")))
    # Without an edge all documents fit under the threshold. At the edge, equal rows remain: the nearest count of them is taken.
    goal = goal.withColumn("_copies", F.when(F.col("_each") > 0, F.floor(F.col("_need") / F.col("_each") + 0.5)).otherwise(0))
    all_ = rows.join(_small(goal.withColumnRenamed("source_size", "_size")), F.col("source").eqNullSafe(F.col("_s")))
    at = F.coalesce(F.col("_h") == F.col("_edge"), F.lit(False))
    out = lambda df, extra: df.select(*rows.drop("_h").columns, F.col("_size").alias("source_size"), "target", F.least(F.col("_base") + extra.cast("int"), F.lit(math.ceil(cap))).alias("repeats"))
    edge = _running(all_.filter(at), [], [], ["source"])
    return out(all_.filter(~at), F.col("_edge").isNull() | (F.col("_h") < F.col("_edge"))).union(out(edge, F.col("_pos") < F.col("_copies")))


def op5(docs: DataFrame) -> DataFrame:
    lean = durable(_measured(docs.select("doc_id", "text", "source")).drop("text"))
    return _select(lean, lean, WEIGHTS, SHARE, MAX_REPEAT).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, {BITS * LEVELS // 4}))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, ([{", ".join(f"{x}::DOUBLE" for x in WEIGHTS)}])[rank % {len(WEIGHTS)} + 1] AS w, {MAX_REPEAT}::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level, row_number() OVER (ORDER BY cap / w, rank) AS pos
    FROM w WINDOW up AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, pos) FROM l WHERE cap > level * w)), cap) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
n AS (SELECT *, target - base * source_size AS need FROM g),
c AS (SELECT source, h, sum(size) AS n, max(size) AS one, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum FROM d GROUP BY source, h),
e AS (SELECT n.source, min(c.h) AS h, arg_min(c.n, c.h) AS edge, arg_min(c.one, c.h) AS one, arg_min(c.cum, c.h) AS cum FROM n JOIN c ON c.source IS NOT DISTINCT FROM n.source AND c.cum > n.need GROUP BY n.source),
b AS (SELECT n.*, e.h AS edge_h, floor((need - (e.cum - e.edge)) / e.one + 0.5) AS copies FROM n LEFT JOIN e ON e.source IS NOT DISTINCT FROM n.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS i FROM d)
SELECT doc_id, size, source_size, target, (size * least(base + (edge_h IS NULL OR h < edge_h OR (h = edge_h AND i <= copies))::INTEGER, {int(MAX_REPEAT)}))::BIGINT AS taken
FROM k JOIN b ON b.source IS NOT DISTINCT FROM k.source
"""
