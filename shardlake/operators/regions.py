"""Regions of surfaces: gates, adjacency, patches, label propagation and cell grids, as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardlake.operators.graph import connected_components, cut
from shardlake.operators.rules import first_match

# The gates of readable regions, in order.
COHERENCE, FILL, SMEAR = 0.5, 0.20, 0.50


def skipped(has_pixels: Column, coherence: Column, fill: Column, smear: Column) -> Column:
    """The first gate a region fails, else null. A metric that is null fails no gate but the first."""
    bad = lambda c: F.coalesce(c, F.lit(False))
    return first_match([(~bad(has_pixels), "no_uv_footprint"), (bad(coherence < COHERENCE), "fragmented_uv"), (bad(fill < FILL), "sparse_uv"), (bad(smear >= SMEAR), "unreliable_texture")])[0]


def patches(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """region, n_patches, contiguous_area of cells (cell, region, area): components over edges (a, b) inside a region.

    A cell without such an edge forms no patch; a region without any has 0 patches and area 0. Null areas count as 0.
    """
    side = lambda n: cells.select(F.col("cell").alias(n), F.col("region").alias("r" + n))
    inner = edges.filter("a <> b").join(side("a"), "a").join(side("b"), "b").filter("ra = rb").select("a", "b")
    comp = connected_components(inner)
    size = cells.join(comp, F.col("cell") == F.col("node")).groupBy("region", "component").agg(F.sum(F.coalesce("area", F.lit(0.0))).alias("s"))
    per = size.groupBy("region").agg(F.count(F.lit(1)).alias("n_patches"), F.max("s").alias("contiguous_area"))
    return cells.select("region").distinct().join(per, "region", "left").na.fill(0, ["n_patches"]).na.fill(0.0, ["contiguous_area"])


def adjacent(cells: DataFrame, edges: DataFrame, share: float = 0.5) -> DataFrame:
    """region, face, boundary_share: the face that most of a region's boundary edges meet, if they are `share` of them.

    cells: (cell, region, face), face null off all faces. Equal counts go to the smaller face.
    """
    side = lambda n: cells.select(F.col("cell").alias(n), F.col("region").alias("r" + n), F.col("face").alias("f" + n))
    pair = edges.join(side("a"), "a").join(side("b"), "b").filter("ra <> rb")
    view = lambda x, y: pair.filter(f"f{x} is null").select(F.col("r" + x).alias("region"), F.col("f" + y).alias("face"))
    n = view("a", "b").union(view("b", "a")).filter("face is not null").groupBy("region", "face").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("region").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("m"), "face")).alias("b"))
    return best.select("region", F.col("b.face").alias("face"), (-F.col("b.m") / F.col("t")).alias("boundary_share")).filter(F.col("boundary_share") >= share)


def propagate(labels: DataFrame, edges: DataFrame, rounds: int = 12) -> DataFrame:
    """cell, label, inferred: unlabelled cells take the commonest label of their neighbours, all at once, round by round.

    Equal counts go to the smallest label. Cells that no label reaches stay null.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    now = cut(labels.select("cell", "label", F.lit(False).alias("inferred")))
    for _ in range(rounds):
        known = now.filter("label is not null").select(F.col("cell").alias("b"), "label")
        votes = both.join(now.filter("label is null").select(F.col("cell").alias("a")), "a").join(known, "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        won = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias("new"))
        step = cut(now.join(won, F.col("cell") == F.col("a"), "left"))
        now = step.select("cell", F.coalesce("label", "new").alias("label"), (F.col("inferred") | F.col("new").isNotNull()).alias("inferred"))
        if step.filter("new is not null").isEmpty():
            break
    return now


def cell_winner(pixels: DataFrame, masked_share: float = 0.3) -> DataFrame:
    """cell, region, excluded: the region with most pixels of each cell (equal counts: the smaller); excluded by masked share."""
    cells = pixels.groupBy("cell").agg((F.avg(F.coalesce(F.col("masked"), F.lit(False)).cast("int")) >= masked_share).alias("excluded"))
    n = pixels.filter("region is not null").groupBy("cell", "region").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("cell").agg(F.min(F.struct((-F.col("n")).alias("m"), "region"))["region"].alias("region"))
    return cells.join(best, "cell", "left").select("cell", F.when(~F.col("excluded"), F.col("region")).alias("region"), "excluded")


def renumber(regions: DataFrame, key: str = "fragment_id") -> DataFrame:
    """Number each fragment's regions from 0 by falling area_frac, ties by region_id."""
    order = Window.partitionBy(key).orderBy(F.desc("area_frac"), "region_id")
    return regions.withColumn("region_id", F.row_number().over(order) - 1)
