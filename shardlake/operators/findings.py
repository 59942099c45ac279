"""Quality findings (level, title, detail) of records, as unions of checks, worst first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("fail", "warn", "ok")


def texel_density(meshes: DataFrame) -> DataFrame:
    """Findings on `density` (px/mm): below 0.5 fails, below 1.0 warns; null warns."""
    d = F.col("density")
    level = F.when(d.isNull(), "warn").when(d < 0.5, "fail").when(d < 1.0, "warn").otherwise("ok")
    return meshes.select("fragment_id", level.alias("level"), F.lit("texel density").alias("title"), F.when(d.isNull(), "unknown").otherwise(F.format_string("%.2f px/mm", d)).alias("detail"))


def _found(df: DataFrame, title: str, level, detail) -> DataFrame:
    return df.select("fragment_id", level.alias("level"), F.lit(title).alias("title"), detail.alias("detail"))


def remesh(meshes: DataFrame, voxel_mm: float = 2.0, least: float = 0.20) -> DataFrame:
    """Fails meshes with under a fifth of the faces that their longest dimension asks for: 3 (dimension / voxel) squared."""
    ratio = F.col("faces") / F.greatest(3.0 * (F.col("longest_mm") / voxel_mm) ** 2, F.lit(1.0))
    return _found(meshes, "remesh resolution", F.when(F.coalesce(ratio < least, F.lit(True)), "fail").otherwise("ok"), F.coalesce(F.format_string("%d %% of expected", F.bround(ratio * 100).cast("long")), F.lit("unknown")))


def uv(meshes: DataFrame) -> DataFrame:
    """Fails meshes without texture coordinates."""
    has = F.coalesce("has_uv", F.lit(False))
    return _found(meshes, "UV coordinates", F.when(has, "ok").otherwise("fail"), F.when(has, "present").otherwise("missing"))


def volume(meshes: DataFrame) -> DataFrame:
    """Warns where the volume is the hull's: the mesh's own must be consistent and 0.2 to 1 of it."""
    own = F.coalesce(F.col("consistent") & (F.col("hull") > 0) & (F.abs("volume") / F.col("hull")).between(0.2, 1.0), F.lit(False))
    return _found(meshes, "volume", F.when(own, "ok").otherwise("warn"), F.when(own, "mesh").otherwise("convex hull"))


def texture(meshes: DataFrame) -> DataFrame:
    """Findings on shares of texture: dark (mean under 12 of 255 fails), marks that hug the margin (over 3 % warn), flat (over 2 % warn)."""
    level = F.when(F.col("mean") < 12, "fail").when((F.col("margin") > 0.03) | (F.col("flat") > 0.02), "warn").otherwise("ok")
    detail = F.when(F.col("mean") < 12, "dark").when(F.col("margin") > 0.03, "margin").when(F.col("flat") > 0.02, "flat").otherwise("fine")
    return _found(meshes, "texture", level, detail)


def sidecar(meshes: DataFrame) -> DataFrame:
    """The first thing wrong with a mesh's sidecar: none, empty, no faces marked, a side that is not vertical or matches nothing, an odd share.

    Columns: has_sidecar, has_unscanned_face, face_count, normal (x, y, z as stored; z counts as up), matched, share.
    """
    n = F.col("normal")
    up = -n[1] / F.nullif(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]), F.lit(0.0))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    steps = [(no(F.col("has_sidecar")), "warn", "not marked"), (no(F.col("has_unscanned_face")), "warn", "empty"), (no(F.col("face_count") > 0), "fail", "group empty"),
             (no(F.abs(up) >= 0.8), "fail", "not vertical"), (no(F.col("matched") > 0), "fail", "no match"), (no(F.col("share").between(0.02, 0.60)), "warn", "odd share"), (up > 0, "warn", "points up")]
    pick = lambda k: reduce(lambda later, s: F.when(s[0], s[k]).otherwise(later), reversed(steps), F.lit("ok" if k == 1 else "located"))
    return _found(meshes, "sidecar", pick(1), pick(2))


def duplicates(meshes: DataFrame) -> DataFrame:
    """Fails for meshes whose face count and volume (3 digits) equal another's; the first other id is named."""
    sig = meshes.filter("faces is not null and volume is not null").select("fragment_id", "faces", F.round("volume", 3).alias("v"))
    ids = sig.groupBy("faces", "v").agg(F.min("fragment_id").alias("first"), F.count_distinct("fragment_id").alias("n")).filter("n > 1")
    second = sig.join(ids, ["faces", "v"]).filter(F.col("fragment_id") != F.col("first")).groupBy("faces", "v").agg(F.min("fragment_id").alias("second"))
    hit = sig.join(ids, ["faces", "v"]).join(second, ["faces", "v"])
    other = F.when(F.col("fragment_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return hit.select("fragment_id", F.lit("fail").alias("level"), F.lit("duplicate mesh").alias("title"), F.concat(F.lit("same as "), other).alias("detail"))


def drift(current: DataFrame, stored: DataFrame, limit: float = 0.15) -> DataFrame:
    """Warns where a dimension moved by more than `limit` of its stored value; records on one side alone give none."""
    both = current.select("fragment_id", F.col("dims").alias("x")).join(stored.select("fragment_id", F.col("dims").alias("y")), "fragment_id")
    far = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b) / F.nullif(b, F.lit(0.0))))
    return both.withColumn("far", far).filter(F.col("far") > limit).select("fragment_id", F.lit("warn").alias("level"), F.lit("identity drift").alias("title"), F.format_string("%.0f %% off", F.col("far") * 100).alias("detail"))


def backfill_violations(fresh: DataFrame, saved: DataFrame, limit: float = 0.005) -> DataFrame:
    """Saved regions (fragment_id, region_id, kind, area_frac) whose fresh ones are missing, of other kind or of other area."""
    new = fresh.select("fragment_id", "region_id", F.col("kind").alias("_kind"), F.col("area_frac").alias("_area"))
    both = saved.join(new, ["fragment_id", "region_id"], "left")
    why = F.when(F.col("_kind").isNull(), "missing").when(F.col("kind") != F.col("_kind"), "kind").when(F.abs(F.col("area_frac") - F.col("_area")) > limit, "area")
    return both.withColumn("violation", why).filter("violation is not null").select("fragment_id", "region_id", "violation")


def taxonomy(features: DataFrame, precedence: list[str]) -> DataFrame:
    """Problems of a taxonomy (feature_id, id, decision_rule, retired): repeated ids, missing rules, precedence that misses or invents ids."""
    order = features.sparkSession.createDataFrame([(p,) for p in precedence], "id string")
    active = features.filter(~F.coalesce("retired", F.lit(False)))
    found = [
        features.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("problem")),
        active.filter("decision_rule is null or decision_rule = ''").select("id", F.lit("no decision rule").alias("problem")),
        active.join(order, "id", "left_anti").select("id", F.lit("not in precedence").alias("problem")),
        order.join(active, "id", "left_anti").select("id", F.lit("unknown in precedence").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, found)


def collect(*checks: DataFrame) -> DataFrame:
    """All findings, by severity, then fragment and title."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return reduce(DataFrame.unionByName, checks).orderBy(rank, "fragment_id", "title")
