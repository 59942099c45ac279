"""Tables behind reports, and joins between regions, faces and sidecars, over nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the face table says of a face without surface of its own.
NONE = "no mesh surface"


def face_table(records: DataFrame) -> DataFrame:
    """fragment_id, face (from 1), surface (its contiguous area to three digits, a note at 0, the hull's without one), hull, rms, connection, assignment."""
    f = records.select("fragment_id", F.posexplode("planarity").alias("i", "f")).select("fragment_id", (F.col("i") + 1).alias("face"), "f.*")
    own = F.col("contiguous_area_m2")
    surface = F.when(own == 0, NONE).otherwise(F.format_string("%.3f", F.coalesce(own, F.col("area_m2_est"))))
    return f.select("fragment_id", "face", surface.alias("surface"), F.col("area_m2_est").alias("hull"), F.col("fit_rms_mm").alias("rms"), F.col("procedural.connection_strategy.value").alias("connection"), F.col("procedural.design_assignment.value").alias("assignment"))


def region_table(records: DataFrame) -> DataFrame:
    """fragment_id, region_id, kind, area_pct, text (features in their order, else why it was skipped, else a dash), masked (the smear's share)."""
    r = records.select("fragment_id", F.explode("vision.regions").alias("r")).select("fragment_id", "r.*")
    said = F.nullif(F.array_join(F.transform("features", lambda x: x["id"]), ", "), F.lit(""))
    return r.select("fragment_id", "region_id", "kind", F.round(F.col("area_frac") * 100, 1).alias("area_pct"), F.coalesce(said, "skipped", F.lit("-")).alias("text"), F.coalesce("smear_frac", F.lit(0.0)).alias("masked"))


def hover(records: DataFrame) -> DataFrame:
    """fragment_id, face (from 0), text of every face: the features of the last region on it, else its surface label, else a dash."""
    last = lambda i: F.try_element_at(F.filter(F.coalesce("vision.regions", F.array().cast(records.schema["vision"].dataType["regions"].dataType)), lambda r: r["plane_index"] == i), F.lit(-1))
    one = F.transform("planarity", lambda f, i: F.struct(i.alias("face"), F.coalesce(F.nullif(F.array_join(F.transform(last(i)["features"], lambda x: x["id"]), ", "), F.lit("")), f["surface_label"], F.lit("-")).alias("text")))
    return records.select("fragment_id", F.explode(one).alias("x")).select("fragment_id", "x.face", "x.text")


def coverage_bar(records: DataFrame, order: list[str]) -> DataFrame:
    """fragment_id, label, place, share of labels with a coverage over 0, in the order of the taxonomy; labels it does not list come last."""
    c = records.select("fragment_id", F.explode("vision.label_coverage").alias("label", "pct")).filter("pct > 0")
    total = F.sum("pct").over(Window.partitionBy("fragment_id"))
    at = F.array_position(F.array(*map(F.lit, order)), F.col("label")).cast("long")
    return c.select("fragment_id", "label", F.when(at > 0, at).otherwise(999).alias("place"), (F.col("pct") / total).alias("share"))


def inventory(records: DataFrame) -> DataFrame:
    """One line a record for an overview: fragment_id, mass, dims as text, faces, handling, uses."""
    dims = F.array_join(F.transform("bounding.obb_dims_mm", lambda d: F.format_string("%.0f", F.bround(d))), " x ")
    n = F.greatest(F.coalesce(F.size("planarity"), F.lit(0)), F.lit(0))
    uses = F.coalesce(F.greatest(F.size("procedural.use_suggestions"), F.lit(0)), F.lit(0))
    return records.select("fragment_id", F.col("bounding.mass_kg_est").alias("mass"), dims.alias("dims"), n.cast("long").alias("faces"), F.col("procedural.handling_class.value").alias("handling"), uses.cast("long").alias("uses"))


def _features(region: Column) -> Column:
    return F.transform(region["features"], lambda x: x["id"])


def write_back(records: DataFrame) -> DataFrame:
    """Faces with the features of the region on them, the first of them as surface label; faces without a region keep theirs.

    Of several regions on a face the last counts; one without features leaves the face without.
    """
    none = F.array().cast(records.schema["vision"].dataType["regions"].dataType)

    def side(f: Column, i: Column) -> Column:
        on = F.try_element_at(F.filter(F.coalesce("vision.regions", none), lambda r: r["plane_index"] == i), F.lit(-1))
        ids = F.coalesce(_features(on), F.array().cast("array<string>"))
        return F.when(on.isNull(), f).otherwise(f.withField("features", ids).withField("surface_label", F.get(ids, F.lit(0))))

    return records.withColumn("planarity", F.transform("planarity", side))


def link_adjacent(records: DataFrame, links: DataFrame) -> DataFrame:
    """Faces with the features of the regions that meet them (links: fragment_id, region_id, face), in the order of regions.

    What was linked before is cleared; features that the face has itself are left out, each comes once. Only regions off all faces count.
    """
    per = links.groupBy(F.col("fragment_id").alias("_id")).agg(F.collect_list(F.struct("region_id", "face")).alias("_links"))
    both = records.join(per, F.col("fragment_id") == F.col("_id"), "left")
    none = F.array().cast("array<string>")
    every = F.coalesce("vision.regions", F.array().cast(records.schema["vision"].dataType["regions"].dataType))

    def side(f: Column, i: Column) -> Column:
        mine = F.transform(F.filter(F.coalesce("_links", F.array().cast("array<struct<region_id:int,face:int>>")), lambda x: x["face"] == i), lambda x: x["region_id"])
        near = F.filter(every, lambda r: r["plane_index"].isNull() & F.array_contains(mine, r["region_id"]))
        got = F.array_distinct(F.flatten(F.transform(near, lambda r: F.coalesce(_features(r), none))))
        own = F.concat(F.coalesce(f["features"], none), F.array_compact(F.array(f["surface_label"])))
        return f.withField("adjacent_features", F.array_except(got, own))

    return both.withColumn("planarity", F.transform("planarity", side)).drop("_id", "_links")


def with_sidecar(records: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Records with the sidecar of their id as scan_coverage; those without one have null. Ids of sidecars are unique."""
    s = sidecars.select(F.col("fragment_id").alias("_id"), F.col("scan_coverage").alias("_s"))
    return records.drop("scan_coverage").join(s, F.col("fragment_id") == F.col("_id"), "left").withColumn("scan_coverage", F.col("_s")).drop("_id", "_s")


def aligned(regions: DataFrame, classified: DataFrame) -> DataFrame:
    """All regions (fragment_id, region_id, skipped) with the label of their classified crop; others have a null label and why they were skipped."""
    c = classified.select(F.col("fragment_id").alias("_f"), F.col("region_id").alias("_r"), F.col("label").alias("_l"))
    both = regions.join(c, (F.col("fragment_id") == F.col("_f")) & (F.col("region_id") == F.col("_r")), "left")
    return both.select("fragment_id", "region_id", F.col("_l").alias("label"), F.when(F.col("_r").isNull(), F.coalesce("skipped", F.lit("not classified"))).alias("skipped"))


def apart(new: DataFrame, used: DataFrame, side: int) -> DataFrame:
    """Squares (image, x, y; side by side) that overlap none of the used ones of their image.

    Squares meet by cells of the side's width: each used one is dealt to the nine around its own, so only near ones are compared.
    """
    cell = lambda c: F.floor(F.col(c) / side)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    u = used.select(F.col("image").alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.explode(steps).alias("s"))
    u = u.select("_i", "_x", "_y", (F.floor(F.col("_x") / side) + F.col("s.a")).alias("_cx"), (F.floor(F.col("_y") / side) + F.col("s.b")).alias("_cy"))
    near = (F.abs(F.col("x") - F.col("_x")) < side) & (F.abs(F.col("y") - F.col("_y")) < side)
    return new.join(u, (F.col("image") == F.col("_i")) & (cell("x") == F.col("_cx")) & (cell("y") == F.col("_cy")) & near, "left_anti")


#: The fields of a region that records keep.
KEPT = (
    "region_id", "kind", "plane_index", "area_frac", "area_m2", "label", "features", "n_features", "anomalies", "n_label_votes",
    "uv_coherence", "uv_fill", "smear_frac", "flat_frac", "colour_entropy_bits", "skipped",
)


def kept_region(region: Column, names: tuple = KEPT) -> Column:
    """The fields of a region that records keep; others, such as its contiguous area, are left out. n_features is counted from the features."""
    field = lambda n: F.coalesce(region[n], F.nullif(F.size(region["features"]), F.lit(-1))) if n == "n_features" else region[n]
    return F.struct(*[field(n).alias(n) for n in names])
