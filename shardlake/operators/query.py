"""Exact structured queries over nested records: one pass, no shuffle but for ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that results may be ranked by.
RANKS = ("mass", "area", "thickness", "faces")


class UnsupportedQuery(ValueError):
    """A field or use that the records do not know."""


def usable_area(face: Column) -> Column:
    return F.coalesce(face["contiguous_area_m2"], face["area_m2_est"])


def own_labels(face: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(face["features"], none), F.when(face["surface_label"].isNotNull(), F.array(face["surface_label"])).otherwise(none)))


def without_surface(records: DataFrame, strip_adjacent: bool = True) -> DataFrame:
    """Records without what was seen on surfaces: vision and the faces' labels, and adjacency too, unless told otherwise.

    Outcomes derived from it remain: `design.geometry_only` derives them again.
    """
    gone = ["surface_label", "features", "anomalies", *(["adjacent_features"] if strip_adjacent else [])]
    types = {"surface_label": "string", "features": "array<string>", "adjacent_features": "array<string>", "anomalies": "array<struct<label:string>>"}

    def bare(face: Column) -> Column:
        for name in gone:
            face = face.withField(name, F.lit(None).cast(types[name]))
        return face

    out = records.withColumn("planarity", F.transform("planarity", bare))
    return out.withColumn("vision", F.lit(None).cast(records.schema["vision"].dataType)) if "vision" in records.columns else out


def select(records: DataFrame, *, use=None, label=None, anomaly=None, min_face_area=None, max_face_rms=None, reliable_only=False,
           min_mass=None, max_mass=None, min_thickness=None, max_thickness=None, handling=None, connection=None, assignment=None,
           drill_zone=None, rank_by=None, top_k=None) -> DataFrame:
    """Records for which all predicates hold, with `why`.

    Face predicates must hold on one and the same face; connection and assignment may hold on any two others. A label
    is looked for on own features first, and on adjacent ones only where the record has no own hit. Null
    mass or thickness fails; null or zero RMS fails max_face_rms; null area counts as 0; absent reliability is true.
    Ranking is descending, null and absent values rank as 0, ties by fragment_id; without ranking the order is that of
    fragment_id. top_k of None or 0 keeps all.
    """
    if rank_by is not None and rank_by not in RANKS:
        raise UnsupportedQuery(f"cannot rank by {rank_by}")
    if top_k is not None and top_k < 0:
        raise UnsupportedQuery("top_k must not be negative")
    df = records.withColumn("_thickness", F.array_min("bounding.obb_dims_mm"))
    faces = F.coalesce(F.col("planarity"), F.array().cast(records.schema["planarity"].dataType))
    why = []

    def plain(f: Column) -> Column:
        ok = F.lit(True)
        if anomaly is not None:
            ok &= F.coalesce(F.exists(f["anomalies"], lambda a: a["label"].eqNullSafe(anomaly)), F.lit(False))
        if min_face_area is not None:
            ok &= F.coalesce(usable_area(f), F.lit(0.0)) >= min_face_area
        if max_face_rms is not None:
            ok &= F.coalesce(F.nullif(f["fit_rms_mm"], F.lit(0.0)), F.lit(1e9)) <= max_face_rms
        if reliable_only:
            ok &= F.coalesce(f["scan_reliable"], F.lit(True))
        return ok

    named = lambda at: F.array_join(F.transform(at, lambda i: F.concat(F.lit("region "), i.cast("string"))), ", ")
    if use is not None:
        df = df.withColumn("_use", F.get(F.filter("procedural.use_suggestions", lambda u: u["id"] == use), 0)).filter("_use is not null")
        via = F.transform("_use.faces", lambda i: i + 1)
        why.append(F.concat(F.lit(f"use {use}"), F.when(F.size(via) > 0, F.concat(F.lit(" via "), named(via))).otherwise("")))
    if label or anomaly or min_face_area or max_face_rms or reliable_only:
        at = F.transform(faces, lambda f, i: F.struct(i.alias("i"), f.alias("f")))
        hits = lambda test: F.transform(F.filter(at, lambda x: plain(x["f"]) & test(x["f"])), lambda x: x["i"] + 1)
        if label:
            own = hits(lambda f: F.array_contains(own_labels(f), label))
            near = hits(lambda f: F.coalesce(F.array_contains(f["adjacent_features"], label), F.lit(False)))
            df = df.withColumn("_own", own).withColumn("_hits", F.when(F.size("_own") > 0, F.col("_own")).otherwise(near))
            text = F.when(F.size("_own") > 0, "").otherwise("on a surface meeting ")
        else:
            df, text = df.withColumn("_hits", hits(lambda f: F.lit(True))), F.lit("")
        df = df.filter(F.size("_hits") > 0)
        why.append(F.concat(text, named("_hits")))
    mass = F.col("bounding.mass_kg_est")
    for column, low, high in ((mass, min_mass, max_mass), (F.col("_thickness"), min_thickness, max_thickness)):
        if low is not None:
            df = df.filter(column >= low)
        if high is not None:
            df = df.filter(column <= high)
    if min_mass is not None or max_mass is not None:
        why.append(F.format_string("%.0f kg", F.bround(mass)))
    for path, value in (("procedural.handling_class.value", handling), ("procedural.drill_zone.value", drill_zone)):
        if value is not None:
            df = df.filter(F.col(path) == value)
    for name, value in (("connection_strategy", connection), ("design_assignment", assignment)):
        if value is not None:
            values = F.transform("planarity", lambda f: f["procedural"][name]["value"])  # noqa: B023 - called at once
            df = df.filter(F.array_contains(values, value))
    df = df.withColumn("why", F.concat_ws("; ", *why))
    areas = F.array_max(F.transform(faces, lambda f: F.coalesce(usable_area(f), F.lit(0.0))))
    value = {"mass": mass, "area": areas, "thickness": F.col("_thickness"), "faces": F.size(faces).cast("double")}
    first = [F.coalesce(value[rank_by], F.lit(0.0)).desc()] if rank_by is not None else []
    df = df.orderBy(*first, "fragment_id")
    if top_k:
        df = df.limit(top_k)
    return df.drop("_thickness", "_own", "_hits", "_use")


def list_uses(records: DataFrame) -> DataFrame:
    """fragment_id and the labels of its uses, joined; `(none)` where it has none."""
    labels = F.array_join(F.transform("procedural.use_suggestions", lambda u: u["label"]), ", ")
    return records.select("fragment_id", F.coalesce(F.nullif(labels, F.lit("")), F.lit("(none)")).alias("uses")).orderBy("fragment_id")


def use_options(records: DataFrame) -> DataFrame:
    """use, label and the number of records that have it, commonest first, then by use."""
    u = records.select("fragment_id", F.explode("procedural.use_suggestions").alias("u")).select("fragment_id", F.col("u.id").alias("use"), F.col("u.label").alias("label"))
    return u.groupBy("use").agg(F.min("label").alias("label"), F.count_distinct("fragment_id").alias("records")).orderBy(F.desc("records"), "use")


def require_use(records: DataFrame, use: str) -> None:
    """Raise UnsupportedQuery if no record knows the use."""
    if records.filter(F.exists("procedural.use_suggestions", lambda u: u["id"] == use)).isEmpty():
        raise UnsupportedQuery(f"no record has the use {use}")
