"""Exact nearest neighbours in space, and the closest point on triangles: a reach that widens only for points whose distance is not yet proven."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardlake.operators.geometry import cross, dot, minus
from shardlake.operators.graph import cut, drop, wide

#: Grid sizes that are tried on the extent of the sites, each half of the one before.
HALVINGS = 16
#: Blocks of space are so many reaches wide; points and sites of the parts into which a crowded block is dealt.
BLOCK, POINTS, SITES = 4, 4_000, 20_000
#: Fixed value: triangles whose centres are nearest are looked at.
CANDIDATES = 12

_AXES = ("x", "y", "z")


def cell_size(sites: DataFrame, most: int) -> float:
    """The widest of the extent's halvings whose occupied cells hold `most` sites on average or fewer; one aggregate, sixteen numbers to the driver."""
    low = sites.agg(*[F.min(a).alias(a) for a in _AXES], F.max(F.greatest(*_AXES)).alias("top"), F.min(F.least(*_AXES)).alias("bottom"), F.count(F.lit(1)).alias("n")).first()
    extent = max((low.top or 0.0) - (low.bottom or 0.0), 1e-12)
    cells = lambda k: F.approx_count_distinct(F.xxhash64(*[F.floor((F.col(a) - F.lit(low[a])) * (2**k / extent)) for a in _AXES]), 0.02)
    got = sites.agg(*[cells(k).alias(f"c{k}") for k in range(HALVINGS)]).first()
    return extent / 2 ** next((k for k in range(HALVINGS) if low.n <= most * got[k]), HALVINGS - 1)


def _met(k: int):
    """Of a part of a block's points and one of the sites around it: each point's k nearest sites, and those as far as the last of them."""

    def meet(points: pa.Table, sites: pa.Table) -> pa.Table:
        p, q = (np.column_stack([t.column(c).to_numpy() for c in _AXES]) for t in (points, sites))
        most, who, what, far = points.column("_most").to_numpy(), [], [], []
        for at in range(0, len(p) if len(q) else 0, 64):
            d = np.sqrt(sum((p[at : at + 64, c, None] - q[None, :, c]) ** 2 for c in range(3)))
            last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(q) > k else np.inf
            i, j = np.nonzero(d <= np.minimum(last, most[at : at + 64])[:, None])
            who.append(at + i), what.append(j), far.append(d[i, j])
        who, what, far = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((who, np.int64), (what, np.int64), (far, float)))
        return points.select(list(_AXES)).take(pa.array(who)).append_column("site", sites.column("site").take(pa.array(what))).append_column("distance", pa.array(far))

    return meet


def nearest(points: DataFrame, sites: DataFrame, k: int, size: float | None = None) -> DataFrame:
    """(id, rank, site, distance): the k nearest sites (site, x, y, z) of each point (id, x, y, z), all if there are fewer; ties to the smaller site.

    A point meets the sites of its block and of a border around it, a reach wide. What it finds within a reach is proven; the others look again with a reach twice as wide (four times
    from the third round on), so the last rounds are of few points. Blocks with many points or sites are dealt into parts that meet each other, so no task holds more than two parts, and
    no side of a join goes through the driver. Points at one place look once, and of sites at one place the k smallest take part: a crowded spot makes no square of pairs.
    Rows with a null or infinite coordinate take no part. A site or point that repeats counts each time.
    """
    real = lambda df: df.select(*df.columns[:1], *[F.col(a).cast("double").alias(a) for a in _AXES]).filter(" and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('Infinity')" for a in _AXES))
    points, sites = real(points.select("id", *_AXES)), real(sites.select("site", *_AXES))
    sites = cut(sites.withColumn("_at", F.row_number().over(Window.partitionBy(*_AXES).orderBy("site"))).filter(F.col("_at") <= k).drop("_at"))
    places = points.select(*_AXES).distinct()
    width = size or cell_size(sites, k)
    found, open_ = [], cut(places.withColumn("_most", F.lit(float("inf"))))  # _most: no neighbour lies farther, as k sites were seen that near
    n = sites.count()
    block, shape = ["i", "j", "l"], f"x double, y double, z double, site {sites.schema['site'].dataType.simpleString()}, distance double"
    while n and not open_.isEmpty():
        side, reach = F.lit(BLOCK * width), F.lit(width * (1 + 1e-9))
        own = open_.select("*", *[F.floor(F.col(a) / side).alias(c) for a, c in zip(_AXES, block)])
        near = sites
        for a, c in zip(_AXES, block):
            near = near.withColumn(c, F.explode(F.sequence(F.floor((F.col(a) - reach) / side), F.floor((F.col(a) + reach) / side))))
        crowd = lambda df, most, name: df.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
        parts = cut(crowd(own, POINTS, "_p").join(wide(crowd(near, SITES, "_s")), block))
        deal = lambda df, mine, other: df.join(wide(parts), block).select(*df.columns, F.pmod(F.xxhash64(*_AXES), F.col(mine)).alias(mine), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other)).groupBy(*block, "_p", "_s")  # noqa: B023, E731 - used at once
        pairs = deal(own, "_p", "_s").cogroup(deal(near, "_s", "_p")).applyInArrow(_met(k), shape)
        place = Window.partitionBy(*_AXES)
        best = pairs.withColumn("rank", F.row_number().over(place.orderBy("distance", "site"))).filter(F.col("rank") <= k)
        top = cut(best.select("*", F.count(F.lit(1)).over(place).alias("_n"), F.max("distance").over(place).alias("_far")))
        enough = F.col("_n") >= min(k, n)
        found.append(cut(top.filter(enough & (F.col("_far") <= width)).drop("_n", "_far")))
        state = open_.drop("_most").join(wide(top.filter("rank = 1").select(*_AXES, "_n", "_far")), [*_AXES], "left")
        rest = cut(state.filter(~F.coalesce(enough & (F.col("_far") <= width), F.lit(False))).select(*_AXES, F.when(enough, F.col("_far")).otherwise(float("inf")).alias("_most")))
        drop(top, open_, parts)
        open_, width = rest, width * (2 if len(found) < 3 else 4)
    if not found:
        return points.select("id", F.lit(0).alias("rank"), F.lit(None).cast(sites.schema["site"].dataType).alias("site"), F.lit(0.0).alias("distance")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return points.join(wide(out), [*_AXES]).select("id", "rank", "site", "distance")


def closest_on_triangle(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Struct (u, v, w): barycentric coordinates of the point of a triangle closest to p; all are arrays of three. A triangle without area is taken as its sides.

    The place is a corner, a point of a side or one inside, told by the signs of six products of sides with ways to the corners.
    """

    def products(x: Column) -> Column:
        ab, ac = x["ab"], x["ac"]
        ways = [dot(s, x[t]) for t in ("ap", "bp", "cp") for s in (ab, ac)]
        return F.struct(*[w.alias(f"d{k}") for k, w in enumerate(ways, 1)])

    def place(x: Column) -> Column:
        d1, d2, d3, d4, d5, d6 = (x[f"d{k}"] for k in range(1, 7))
        va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
        at = lambda v, w: F.struct((1 - v - w).alias("u"), v.alias("v"), w.alias("w"))
        zero, one = F.lit(0.0), F.lit(1.0)
        far = F.try_divide(d4 - d3, (d4 - d3) + (d5 - d6))
        inside = va + vb + vc
        return (
            F.when((d1 <= 0) & (d2 <= 0), at(zero, zero))
            .when((d3 >= 0) & (d4 <= d3), at(one, zero))
            .when((vc <= 0) & (d1 >= 0) & (d3 <= 0), at(F.try_divide(d1, d1 - d3), zero))
            .when((d6 >= 0) & (d5 <= d6), at(zero, one))
            .when((vb <= 0) & (d2 >= 0) & (d6 <= 0), at(zero, F.try_divide(d2, d2 - d6)))
            .when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), at(1 - far, far))
            .otherwise(at(F.try_divide(vb, inside), F.try_divide(vc, inside)))
        )

    ways = F.struct(*[v.alias(n) for n, v in (("ab", minus(b, a)), ("ac", minus(c, a)), ("ap", minus(p, a)), ("bp", minus(p, b)), ("cp", minus(p, c)))])
    # the sides and products as variables of functions: each is worked out once a row
    return F.get(F.transform(F.transform(F.array(ways), products), place), F.lit(0))


def nearest_triangle(points: DataFrame, triangles: DataFrame, candidates: int = CANDIDATES, size: float | None = None) -> DataFrame:
    """(id, triangle, u, v, w, distance, facing): the closest of the triangles whose centres are nearest, one that faces the point's way if any does.

    Points: id, p and normal; triangles: triangle, a, b, c (arrays of three). Facing: the triangle's normal and the point's have a positive product. Ties go to the
    nearer centre, then to the smaller triangle. Points without triangles are absent. ids and triangles are unique.
    """
    centres = triangles.select(F.col("triangle").alias("site"), *[((F.col("a")[k] + F.col("b")[k] + F.col("c")[k]) / 3).alias(x) for k, x in enumerate(_AXES)])
    near = nearest(points.select("id", *[F.col("p")[k].alias(x) for k, x in enumerate(_AXES)]), centres, candidates, size)
    both = near.select("id", "rank", F.col("site").alias("triangle")).join(wide(triangles.select("triangle", "a", "b", "c")), "triangle").join(wide(points.select("id", "p", "normal")), "id")
    both = both.withColumn("at", closest_on_triangle(F.col("p"), F.col("a"), F.col("b"), F.col("c")))
    hit = F.array(*[F.col("at.u") * F.col("a")[k] + F.col("at.v") * F.col("b")[k] + F.col("at.w") * F.col("c")[k] for k in range(3)])
    both = both.withColumn("hit", hit).withColumn("facing", F.coalesce(dot(cross(minus(F.col("b"), F.col("a")), minus(F.col("c"), F.col("a"))), F.col("normal")) > 0, F.lit(False)))
    way = minus(F.col("p"), F.col("hit"))
    one = F.struct((~F.col("facing")).alias("back"), F.sqrt(dot(way, way)).alias("distance"), "rank", "triangle", "at")
    best = both.groupBy("id").agg(F.min(one).alias("m"))
    return best.select("id", "m.triangle", "m.at.u", "m.at.v", "m.at.w", "m.distance", (~F.col("m.back")).alias("facing"))
