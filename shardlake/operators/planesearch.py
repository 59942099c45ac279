"""Plane search over all clouds at once: hypotheses are a small table, inliers are counted by partial aggregation, and planes are peeled off round by round."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlake.operators import hulls
from shardlake.operators.graph import cut, drop, wide
from shardlake.operators.kernels import PLANE_MM, PLANES, SEED, STOP
from shardlake.operators.kernels import TRIES as LIMIT

#: Planes through three points that a cloud's round tries at first, and points of the parts into which a larger cloud is dealt to meet them.
TRIES, SHARE = 200, 20_000
#: A round tries on while a plane with as many points as its best one may have been missed with more than this chance, up to the tries of a single cloud's search.
MISS = 0.001

_FOUND = "normal array<double>, u array<double>, v array<double>, d double, rms double"


def _hypotheses(points: DataFrame, sizes: DataFrame, tries: int, salt: int, most: int) -> DataFrame:
    """(key, salts, at, nx, ny, nz, d): planes through three points each, the points with the smallest digests of a draw. Few rows pass the first threshold, however large a cloud.

    sizes: key, n (points of the cloud), draws (numbers of draws); each gives `tries` planes, or as many as there are points for. No point is in two planes of a draw.
    """
    asked = points.join(wide(sizes), "key").withColumn("draw", F.explode("draws"))
    h = F.pmod(F.xxhash64("id", "x", "y", "z", F.lit(salt) + F.col("draw") * most), F.lit(1 << 32))
    near = asked.withColumn("h", h).filter(F.col("h") / float(1 << 32) * F.col("n") <= 6 * tries + 30)
    place = F.row_number().over(Window.partitionBy("key", "draw").orderBy("h", "id", "x", "y", "z")) - 1
    some = near.withColumn("place", place).filter(F.col("place") < 3 * tries).withColumn("at", F.col("draw") * F.lit(tries).cast("long") + F.floor(F.col("place") / 3))
    corner = lambda k, c: F.max(F.when(F.col("place") % 3 == k, F.col(c))).alias(f"{c}{k}")
    three = some.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts"), *[corner(k, c) for k in range(3) for c in "xyz"]).filter("n = 3")
    a, b = ([F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"] for k in (1, 2))
    n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    cross = three.select("key", "salts", "at", "x0", "y0", "z0", *[v.alias(f"n{c}") for v, c in zip(n, "xyz")]).withColumn("size", F.sqrt(sum(F.col(f"n{c}") * F.col(f"n{c}") for c in "xyz"))).filter("size > 1e-12")
    unit = cross.select("key", "salts", "at", "x0", "y0", "z0", *[(F.col(f"n{c}") / F.col("size")).alias(f"n{c}") for c in "xyz"])
    return unit.withColumn("d", -sum(F.col(f"n{c}") * F.col(f"{c}0") for c in "xyz")).select("key", "salts", "at", "nx", "ny", "nz", "d")


def _doubtful(sizes: DataFrame, best: DataFrame, tries: int) -> DataFrame:
    """(key, n, draws): clouds whose tries so far may have missed a plane as good as their best one, with the further draws that settle it: a better plane in them needs no more."""
    share, each = F.coalesce("inliers", F.lit(0)) / F.col("n"), F.least(F.lit(tries), F.floor(F.col("n") / 3))
    need = F.when(share < 1, F.least(F.lit(float(max(tries, LIMIT))), F.coalesce(F.try_divide(F.lit(float(np.log(MISS))), F.log(1 - share * share * share)), F.lit(float("inf"))))).otherwise(0)
    more = F.ceil((need - each) / each).cast("int")
    both = sizes.filter("n >= 3").join(wide(best.select("key", "inliers")), "key", "left")
    return both.select("key", "n", more.alias("more")).filter("more > 0").select("key", "n", F.sequence(F.lit(1), F.col("more")).alias("draws"))


def _near(limit: float):
    return F.abs(sum(F.col(f"n{c}") * F.col(c) for c in "xyz") + F.col("d")) <= limit


def _counted(limit: float):
    """Of a part of a cloud and its planes: how many points lie near each. Where the part is the whole cloud only the best plane is told, of equals the earliest."""

    def count(points: pa.Table, planes: pa.Table) -> pa.Table:
        n = np.zeros(planes.num_rows, np.int64)
        if len(n):
            planes = planes.sort_by("at")
            nx, ny, nz, d = (planes.column(c).to_numpy() for c in ("nx", "ny", "nz", "d"))
            xyz = np.column_stack([points.column(c).to_numpy() for c in "xyz"]).astype(float)
            for k in range(0, len(xyz), 256):
                x, y, z = (xyz[k : k + 256, a, None] for a in range(3))
                n += (np.abs(nx * x + ny * y + nz * z + d) <= limit).sum(0)
        told = np.flatnonzero(n > 0)
        if len(told) and planes.column("salts")[0].as_py() == 1:
            told = np.array([n.argmax()])
        return planes.take(pa.array(told)).select(["key", "at", "nx", "ny", "nz", "d"]).append_column("inliers", pa.array(n[told]))

    return count


def _fitted(frames):
    """The plane through each row's moments: normal, two axes in it, d and the points' distance from it."""
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            mean = np.array([r.mx, r.my, r.mz])
            cov = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
            value, axes = np.linalg.eigh(cov)
            n = axes[:, 0]
            out.append((r.key, n.tolist(), axes[:, 2].tolist(), axes[:, 1].tolist(), float(-mean @ n), float(np.sqrt(max(value[0], 0.0)))))
        yield pd.DataFrame(out, columns=["key", "normal", "u", "v", "d", "rms"])


def _area(table: pa.Table) -> pa.Table:
    xy = np.column_stack([table.column(c).to_numpy() for c in "xy"])
    ring = xy[hulls.polygon(xy)]
    area = abs(float(ring[:, 0] @ np.roll(ring[:, 1], -1) - ring[:, 1] @ np.roll(ring[:, 0], -1))) / 2 if len(ring) > 2 else None
    return pa.table({"key": table.column("key")[:1], "area": pa.array([area], pa.float64())})


def search(points: DataFrame, key: str, tries: int = TRIES, most: int = PLANES, limit: float = PLANE_MM, stop: float = STOP, seed: int = SEED) -> DataFrame:
    """key, plane (from 0, by falling hull area, null as 0), normal, d, inliers, fraction, area (of the inliers' hull on the plane), rms of clouds (key, id, x, y, z).

    Each round, every cloud takes the best of `tries` planes through three of its points (chosen by digest: the same for any partitioning; equal counts: the
    earlier one), fits it anew to its inliers and goes on with the rest, until the best has under `stop` of all points, or fewer than three. Where `tries` planes
    leave a chance over MISS that one as good as the best was not among them, the cloud tries as many more as that takes, LIMIT in all: of many clouds some have bad luck.
    No cloud is a group: points meet hypotheses by key and part of the cloud, SHARE points each, and counts, moments and hulls are partial
    aggregates. Rows with a null coordinate take no part; null keys are one cloud.
    """
    kind = points.schema[key].dataType.simpleString()
    all_ = points.select(F.col(key).alias("key"), "id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna(subset=["x", "y", "z"]).withColumn("nil", F.col("key").isNull())
    all_ = cut(all_.withColumn("key", F.struct("nil", "key")).drop("nil"))  # a key that joins, null or not
    total = all_.groupBy("key").agg(F.count(F.lit(1)).alias("total")).withColumn("salts", F.ceil(F.col("total") / SHARE))
    base = open_ = cut(all_.join(wide(total), "key").withColumn("salt", F.pmod(F.xxhash64("id", "x", "y"), F.col("salts"))))
    drop(all_)
    found = []
    for k in range(most):
        sizes = cut(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        plane = ["nx", "ny", "nz", "d"]
        shape = f"key {open_.schema['key'].dataType.simpleString()}, at long, nx double, ny double, nz double, d double, inliers long"
        parts = open_.select("key", "salt", "x", "y", "z").groupBy("key", "salt")
        top = lambda df: df.groupBy("key").agg(F.max(F.struct("inliers", "first", *plane)).alias("b")).select("key", "b.*")  # noqa: B023, E731 - used at once

        def tried(asked: DataFrame) -> DataFrame:
            """The best plane of each cloud among those of its draws."""
            made = cut(_hypotheses(open_, asked, tries, seed + k, most))  # noqa: B023 - used at once
            dealt = made.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
            counts = parts.cogroup(dealt.groupBy("key", "salt")).applyInArrow(_counted(limit), shape)  # noqa: B023
            best = cut(top(counts.groupBy("key", "at", *plane).agg(F.sum("inliers").alias("inliers")).withColumn("first", -F.col("at"))))  # noqa: B023
            drop(made)
            return best

        best = tried(sizes.withColumn("draws", F.array(F.lit(0))))
        doubtful = cut(_doubtful(sizes, best, tries))
        if not doubtful.isEmpty():
            again = tried(doubtful)
            both = cut(top(best.unionByName(again)))
            drop(best, again)
            best = both
        both = open_.join(wide(best), "key").filter((F.col("inliers") >= 3) & (F.col("inliers") >= stop * F.col("total")))
        both = cut(both.select("key", "id", "x", "y", "z", "total", "salts", "salt", _near(limit).alias("on")))
        drop(base, best, sizes, doubtful)
        base, inner = both, both.filter("on")
        if inner.isEmpty():
            break
        pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
        moments = inner.groupBy("key").agg(F.count(F.lit(1)).alias("inliers"), F.max("total").alias("total"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(*p).alias(p) for p in pairs])
        moments = cut(moments.withColumn("name", F.to_json("key")))
        plain = moments.select(F.col("name").alias("key"), *[f"m{c}" for c in "xyz"], *pairs)
        fit = plain.mapInPandas(_fitted, f"key string, {_FOUND}").withColumnRenamed("key", "name")
        fitted = cut(moments.select("key", "name", "inliers", "total").join(wide(fit), "name"))
        named = inner.select("key", "x", "y", "z").join(wide(fitted.select("key", "name", "u", "v")), "key")
        flat = named.select("name", *[sum(F.col(c) * F.col(a)[j] for j, c in enumerate("xyz")).alias(x) for x, a in (("x", "u"), ("y", "v"))], F.lit(0.0).alias("z"))
        area = hulls.merged(flat, "name").groupBy("key").applyInArrow(_area, "key string, area double").withColumnRenamed("key", "name")
        found.append(cut(fitted.join(wide(area), "name").select("key", F.lit(k).alias("round"), "normal", "d", "inliers", (F.col("inliers") / F.col("total")).alias("fraction"), "area", "rms")))
        drop(moments, fitted)
        open_ = both.filter("not on").drop("on")
    drop(base)
    if not found:
        return points.select(F.col(key)).limit(0).selectExpr(f"`{key}`", "0 AS plane", "array(0.0D) AS normal", "0.0D AS d", "0L AS inliers", "0.0D AS fraction", "0.0D AS area", "0.0D AS rms")
    all_ = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("key").orderBy(F.coalesce("area", F.lit(0.0)).desc(), "round")
    return all_.select(F.col("key.key").cast(kind).alias(key), (F.row_number().over(order) - 1).alias("plane"), "normal", "d", "inliers", "fraction", "area", "rms")
