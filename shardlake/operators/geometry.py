"""Meshes and point clouds as tables: triangles, vertices, planes. Vectors are columns x, y, z or arrays of three."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardlake.operators.graph import wide

# Limits of the plane, cluster and pool steps, the unscanned side and the assumed density.
PLANE_MM, PLANE_DEG, CLUSTER_SHARE, CLUSTER_LEAST, POOL_SHARE = 8.0, 30.0, 0.01, 50, 0.02
UNSCANNED_DEG, UNSCANNED_MM, DENSITY = 20.0, 80.0, 2500.0


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Column, b: Column) -> Column:
    return F.array(*[a[k] - b[k] for k in range(3)])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def triangles(tri: DataFrame) -> DataFrame:
    """Add area, normal (unit; null where degenerate), centre and signed volume to triangles with corners a, b, c (arrays of three)."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    n = cross(minus(b, a), minus(c, a))
    size = F.nullif(norm(n), F.lit(0.0))
    return tri.withColumn("area", norm(n) / 2).withColumn("normal", F.when(size.isNotNull(), F.transform(n, lambda x: x / size))).withColumn("centre", F.array(*[(a[k] + b[k] + c[k]) / 3 for k in range(3)])).withColumn("volume", dot(a, cross(b, c)) / 6)


def totals(tri: DataFrame, key: str) -> DataFrame:
    """key, faces, area, volume (absolute) and centroid (weighted by area) of each mesh; one aggregation, no shuffle of triangles."""
    t = triangles(tri)
    area = F.sum("area")
    middle = F.array(*[F.try_divide(F.sum(F.col("area") * F.col("centre")[k]), area) for k in range(3)])
    return t.groupBy(key).agg(F.count(F.lit(1)).alias("faces"), area.alias("area"), F.abs(F.sum("volume")).alias("volume"), middle.alias("centroid"))


def centred(points: DataFrame, key: str) -> DataFrame:
    """Points x, y, z moved so that each cloud's mean is the origin; clouds meet their means by key, as an aggregate."""
    mean = points.groupBy(key).agg(*[F.avg(c).alias("_" + c) for c in "xyz"])
    return points.join(mean, key).select(*[(F.col(c) - F.col("_" + c)).alias(c) if c in "xyz" else F.col(c) for c in points.columns])


def edges(tri: DataFrame, key: str) -> DataFrame:
    """key, u, v (u < v), n and balance of each edge of triangles over vertex ids i, j, k: two faces in opposite directions are closed."""
    e = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("i", "j"), ("j", "k"), ("k", "i"))])
    one = tri.select(key, F.explode(e).alias("e"))
    low, high = F.least("e.p", "e.q"), F.greatest("e.p", "e.q")
    return one.groupBy(key, low.alias("u"), high.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("e.p") == low, 1).otherwise(-1)).alias("balance"))


def closed(tri: DataFrame, key: str) -> DataFrame:
    """key, watertight (every edge has two faces) and consistent (they run it in opposite directions)."""
    return edges(tri, key).groupBy(key).agg(F.min(F.col("n") == 2).alias("watertight"), F.min((F.col("n") != 2) | (F.col("balance") == 0)).alias("consistent"))


def volume_source(watertight: Column, consistent: Column, volume: Column, hull: Column) -> Column:
    """mesh, mesh_nearly_closed (consistent, with 0.2 to 1 of the hull's volume) or convex_hull. Nulls count as no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(watertight), "mesh").when(yes(consistent) & yes(F.try_divide(volume, hull).between(0.2, 1.0)), "mesh_nearly_closed").otherwise("convex_hull")


def bounding(df: DataFrame, volume: Column, hull: Column, watertight: Column, consistent: Column) -> DataFrame:
    """Add volume_source, volume_mm3, convexity (null without a hull) and mass_kg_est at the assumed density."""
    source = volume_source(watertight, consistent, volume, hull)
    used = F.when(source == "convex_hull", hull).otherwise(volume)
    return df.select("*", source.alias("volume_source"), used.alias("volume_mm3"), F.when(source != "convex_hull", F.try_divide(volume, hull)).alias("convexity"), (used * 1e-9 * DENSITY).alias("mass_kg_est"))


def sorted_dims(dims: Column, axes: Column) -> Column:
    """Structs (dim, axis) by falling dimension: axes go with their dimensions; equal dimensions keep their order."""
    both = F.transform(F.arrays_zip(dims.alias("dim"), axes.alias("axis")), lambda x, i: F.struct((-x["dim"]).alias("m"), i.alias("i"), x["dim"].alias("dim"), x["axis"].alias("axis")))
    return F.transform(F.array_sort(both), lambda x: F.struct(x["dim"].alias("dim"), x["axis"].alias("axis")))


def sorted_planes(planes: Column) -> Column:
    """Planes by falling hull area, null as 0; of equal ones the first stays first. Their places are the faces' indices."""
    at = F.transform(planes, lambda p, i: F.struct((-F.coalesce(p["area_m2_est"], F.lit(0.0))).alias("m"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(at), lambda x: x["p"])


def nearest_plane(faces: DataFrame, planes: list[tuple[int, list[float], float]], centre: str = "centre", normal: str = "normal", limit: float = PLANE_MM, degrees: float | None = PLANE_DEG) -> DataFrame:
    """Add plane and distance: the nearest plane (id, unit normal, d) nearer than limit whose normal lies within degrees, else null.

    Ties go to the plane listed first. Planes are few (a mesh has eight at most) and become an array of literals: no join.
    """
    c, n = F.col(centre), F.col(normal)
    far = F.lit(None).cast("struct<distance:double,at:int,plane:int>")
    options = []
    for at, (plane, axis, d) in enumerate(planes):
        a = F.array(*[F.lit(float(x)) for x in axis])
        dist = F.abs(dot(c, a) + d)
        ok = dist < limit
        if degrees is not None:
            ok &= F.abs(dot(n, a)) >= math.cos(math.radians(degrees))
        options.append(F.when(ok, F.struct(dist.alias("distance"), F.lit(at).alias("at"), F.lit(plane).alias("plane"))).otherwise(far))
    best = F.array_min(F.array(*options)) if options else far
    return faces.withColumn("_b", best).select(*faces.columns, F.col("_b.plane").alias("plane"), F.col("_b.distance").alias("distance"))


def assemble(faces: DataFrame, key: str) -> DataFrame:
    """key, part, kind, area, area_frac, region_id of surface parts from faces (key, plane, cluster, area, unscanned).

    Faces on planes are one part a plane; others one a cluster if it has CLUSTER_SHARE of the mesh's faces and CLUSTER_LEAST at least;
    the rest, and parts under POOL_SHARE of the scanned area (rounded to four digits), are the residual. Unscanned faces count
    among the faces, but have no part in areas. Numbered from 0 by falling rounded share, then by part.
    """
    f = faces.withColumn("_open", ~F.coalesce("unscanned", F.lit(False)))
    part = F.when(F.col("plane").isNotNull(), F.concat(F.lit("plane "), F.lpad(F.col("plane").cast("string"), 12, "0"))).when(F.col("cluster").isNotNull(), F.concat(F.lit("rough "), F.lpad(F.col("cluster").cast("string"), 12, "0"))).otherwise("residual")
    size = f.groupBy(key).agg(F.count(F.lit(1)).alias("_all"), F.sum(F.when(F.col("_open"), F.col("area"))).alias("_area"))
    n = f.filter("_open").groupBy(key, part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")).join(size, key)
    small = F.col("part").startswith("rough") & (F.col("n") < F.greatest(F.col("_all") * CLUSTER_SHARE, F.lit(float(CLUSTER_LEAST))))
    pooled = n.withColumn("part", F.when(small, "residual").otherwise(F.col("part"))).groupBy(key, "part").agg(F.sum("area").alias("area"), F.first("_area").alias("_area"))
    share = F.round(F.try_divide(F.col("area"), F.col("_area")), 4)
    last = pooled.withColumn("part", F.when(share < POOL_SHARE, "residual").otherwise(F.col("part"))).groupBy(key, "part").agg(F.sum("area").alias("area"), F.first("_area").alias("_area"))
    last = last.select(key, "part", F.when(F.col("part").startswith("plane"), "plane").when(F.col("part") == "residual", "residual").otherwise("cluster").alias("kind"), "area", share.alias("area_frac"))
    return last.withColumn("region_id", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("area_frac"), "part")) - 1)


def unscanned(faces: DataFrame, key: str, side: Column) -> DataFrame:
    """Add unscanned: faces whose normal is near the side's (stored x, y, z, turned to x, z, -y) and that lie lowest, null without such a face.

    faces have normal and centre; lowest means within UNSCANNED_MM of the lowest face of that direction. One window value a mesh,
    made as an aggregate and joined back.
    """
    u = F.array(side[0], side[2], -side[1])
    cos = F.abs(dot(F.col("normal"), u)) / F.nullif(norm(u), F.lit(0.0))
    f = faces.withColumn("_near", F.coalesce(cos >= math.cos(math.radians(UNSCANNED_DEG)), F.lit(False)))
    low = f.filter("_near").groupBy(F.col(key).alias("_k")).agg(F.min(F.col("centre")[1]).alias("_low"))
    both = f.join(low, F.col(key) == F.col("_k"), "left")
    return both.select(*faces.columns, F.when(F.col("_low").isNotNull(), F.col("_near") & (F.col("centre")[1] < F.col("_low") + UNSCANNED_MM)).alias("unscanned"))


def roughness(points: DataFrame, key: str, radius: float, least: int = 3) -> DataFrame:
    """key, id, neighbours, roughness: deviation of the angles between normals near a point and their mean, over all points within radius (itself too).

    points: key, id, x, y, z, nx, ny, nz. Points meet by cells of the radius' width: each is dealt to the 27 cells around its own, so
    only near ones are compared. Fewer than `least` neighbours, or normals that cancel out, give null.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    asks = points.select(key, "id", "x", "y", "z", F.explode(steps).alias("s")).select(key, "id", "x", "y", "z", (cell("x") + F.col("s.a")).alias("cx"), (cell("y") + F.col("s.b")).alias("cy"), (cell("z") + F.col("s.c")).alias("cz"))
    near = points.select(F.col(key).alias("_k"), *[F.col(c).alias("_" + c) for c in ("x", "y", "z", "nx", "ny", "nz")], cell("x").alias("_cx"), cell("y").alias("_cy"), cell("z").alias("_cz"))
    same = (F.col(key) == F.col("_k")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & (F.col("cz") == F.col("_cz"))
    dist = sum((F.col(c) - F.col("_" + c)) ** 2 for c in "xyz")
    both = asks.join(near, same & (dist <= radius * radius))
    mean = both.groupBy(key, "id").agg(F.count(F.lit(1)).alias("neighbours"), *[F.avg("_" + c).alias("m" + c) for c in ("nx", "ny", "nz")])
    size = F.sqrt(F.col("mnx") ** 2 + F.col("mny") ** 2 + F.col("mnz") ** 2)
    ok = mean.filter((F.col("neighbours") >= least) & (size >= 1e-8)).select(F.col(key).alias("_mk"), F.col("id").alias("_mid"), *[(F.col("m" + c) / size).alias("u" + c) for c in ("nx", "ny", "nz")])
    cos = F.least(F.greatest(sum(F.col("_" + c) * F.col("u" + c) for c in ("nx", "ny", "nz")), F.lit(-1.0)), F.lit(1.0))
    spread = both.join(ok, (F.col(key) == F.col("_mk")) & (F.col("id") == F.col("_mid"))).groupBy(F.col(key).alias("_k2"), F.col("id").alias("_i2")).agg(F.stddev_pop(F.acos(cos)).alias("roughness"))
    return mean.join(spread, (F.col(key) == F.col("_k2")) & (F.col("id") == F.col("_i2")), "left").select(key, "id", "neighbours", "roughness")


def summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """mean, population deviation, quartiles (linear) and root mean square of a value; keys without a value have nulls."""
    v = F.col(value)
    return df.groupBy(key).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.75).alias("p75"), F.sqrt(F.avg(v * v)).alias("rms"))


def weld(vertices: DataFrame, tri: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Triangles over the smallest vertex id of each rounded place; those with two equal corners are dropped."""
    place = [F.round(F.col(c) / tolerance).cast("long").alias("_" + c) for c in "xyz"]
    v = vertices.select(key, "id", *place)
    first = v.groupBy(key, "_x", "_y", "_z").agg(F.min("id").alias("to"))
    to = v.join(wide(first), [key, "_x", "_y", "_z"]).select(F.col(key).alias("_k"), F.col("id").alias("_from"), "to")
    out = tri
    for c in ("i", "j", "k"):
        out = out.join(wide(to), (F.col(key) == F.col("_k")) & (F.col(c) == F.col("_from"))).withColumn(c, F.col("to")).drop("_k", "_from", "to")
    return out.filter("i <> j and j <> k and i <> k")


def vertex_normals(tri: DataFrame, key: str) -> DataFrame:
    """key, id, normal: the sum of the faces' cross products at each vertex, brought to length 1; null where they cancel out."""
    n = cross(minus(F.col("b"), F.col("a")), minus(F.col("c"), F.col("a")))
    corner = tri.select(key, F.explode(F.array("i", "j", "k")).alias("id"), n.alias("n"))
    s = corner.groupBy(key, "id").agg(*[F.sum(F.col("n")[k]).alias(c) for k, c in enumerate("xyz")])
    v = F.array("x", "y", "z")
    return s.select(key, "id", F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).alias("normal"))


def newell(ring: DataFrame, key: str, order: str) -> DataFrame:
    """key, normal (not brought to length 1) of polygons with corners x, y, z in order: Newell's sums over each corner and the next."""
    w = Window.partitionBy(key).orderBy(order)
    rest = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(rest)) for c in "xyz"}
    r = ring.select(key, "x", "y", "z", *[v.alias("_" + c) for c, v in after.items()])
    term = lambda p, q: F.sum((F.col(p) - F.col("_" + p)) * (F.col(q) + F.col("_" + q)))
    return r.groupBy(key).agg(F.array(term("y", "z"), term("z", "x"), term("x", "y")).alias("normal"))


def texel_density(meshes: DataFrame) -> DataFrame:
    """Add density in px a mm from uv_area (share of the atlas), atlas_px (its side) and area_mm2; null without an area."""
    return meshes.withColumn("density", F.sqrt(F.try_divide(F.col("uv_area") * F.col("atlas_px") * F.col("atlas_px"), F.col("area_mm2"))))


def autoscaled(points: DataFrame, key: str) -> DataFrame:
    """Points x, y, z in mm: clouds whose longest extent is under 10 are in metres and times 1000; adds `scale` and `plausible` (50 to 5000 mm)."""
    longest = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"])
    s = points.groupBy(key).agg(longest.alias("_e")).select(F.col(key).alias("_k"), F.when(F.col("_e") < 10, 1000.0).otherwise(1.0).alias("scale"), "_e")
    both = points.join(s, F.col(key) == F.col("_k"))
    return both.select(*[(F.col(c) * F.col("scale")).alias(c) if c in "xyz" else F.col(c) for c in points.columns], "scale", (F.col("_e") * F.col("scale")).between(50, 5000).alias("plausible"))


#: The code of the unscanned side in viewer samples.
UNSCANNED_CODE = 100


def viewer(points: DataFrame, key: str, planes: list[tuple[int, list[float], float]], limit: float = 5.0) -> DataFrame:
    """Points (key, id, x, y, z, unscanned) with code and places in -1 to 1: the nearest plane within limit whatever the normals, -1 off all, UNSCANNED_CODE on that side.

    Clouds are centred on the middle of their extent and divided by half of the longest one; a cloud of one place stays at 0.
    """
    p = nearest_plane(points.withColumn("_c", F.array("x", "y", "z")), planes, "_c", "_c", limit, None).drop("_c")
    box = points.groupBy(F.col(key).alias("_k")).agg(*[((F.max(c) + F.min(c)) / 2).alias("_m" + c) for c in "xyz"], (F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]) / 2).alias("_h"))
    both = p.join(box, F.col(key) == F.col("_k"))
    code = F.when(F.coalesce("unscanned", F.lit(False)), UNSCANNED_CODE).otherwise(F.coalesce("plane", F.lit(-1)))
    return both.select(key, "id", code.alias("code"), *[F.coalesce(F.try_divide(F.col(c) - F.col("_m" + c), F.col("_h")), F.lit(0.0)).alias(c) for c in "xyz"])
