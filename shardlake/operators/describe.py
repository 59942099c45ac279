"""From meshes and clouds to records: volume and its source, box, mass and planes of every fragment, in the records' schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardlake.operators import geometry, hulls, planesearch, surface
from shardlake.operators.graph import wide
from shardlake.sources.records import SCHEMA

#: Places nearer than this, in the meshes' unit, are one vertex; points that the plane search gets of a mesh.
WELD, SAMPLE = 1e-4, 50_000


def _kind() -> StructType:
    return StructType.fromDDL(SCHEMA)


def _struct(kind, fields: dict[str, Column]) -> Column:
    return F.struct(*[(fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


def _box(df: DataFrame) -> Column:
    """The bounding block of a row with hull_volume, obb_*, volume_*, convexity and mass."""
    rounded = F.transform("obb_dims_mm", lambda d: F.round(d, 1))
    axes = F.transform("obb_axes_xyz", lambda a: F.transform(a, lambda x: F.round(x, 4)))
    fields = {"obb_dims_mm": rounded, "obb_axes_xyz": axes, "volume_mm3": F.round("volume_mm3", 1), "volume_source": F.col("volume_source"), "convexity": F.round("convexity", 4), "mass_kg_est": F.round("mass_kg_est", 3), "watertight": F.col("watertight")}
    return _struct(_kind()["bounding"].dataType, fields)


def mesh_sums(tri: DataFrame, key: str) -> DataFrame:
    """key, volume, watertight, consistent, hull_points, hull_volume, obb_dims_mm and obb_axes_xyz of meshes of triangles (key, a, b, c with vertex numbers i, j, k).

    Vertices at one place (to WELD) are one before it is judged whether a mesh is closed, as exports split them along seams. A mesh is never one task: its
    sums are aggregates, its hull is merged from parts. Triangles with a null corner take no part.
    """
    whole = tri.dropna(subset=["a", "b", "c", "i", "j", "k"])
    corner = whole.select(key, F.explode(F.array(*[F.struct(F.col(n).alias("id"), F.col(p).alias("p")) for n, p in (("i", "a"), ("j", "b"), ("k", "c"))])).alias("v"))
    points = corner.select(key, F.col("v.id").alias("id"), *[F.col("v.p")[n].cast("double").alias(x) for n, x in enumerate("xyz")]).distinct()
    welded = geometry.weld(points, whole.select(key, "i", "j", "k"), key, WELD)
    sums = geometry.totals(whole, key).select(key, "volume").join(wide(geometry.closed(welded, key)), key, "left").join(wide(hulls.bounding_boxes(points, key)), key)
    return sums.withColumn("watertight", F.coalesce("watertight", F.lit(False)))


def mesh_bounds(tri: DataFrame, key: str) -> DataFrame:
    """key and bounding of meshes (see `mesh_sums`): oriented box, volume by the ladder of sources, convexity, mass."""
    done = geometry.bounding(mesh_sums(tri, key), F.col("volume"), F.col("hull_volume"), F.col("watertight"), F.col("consistent"))
    return done.select(key, _box(done).alias("bounding"))


def cloud_bounds(points: DataFrame, key: str) -> DataFrame:
    """key and bounding of clouds of points x, y, z: the hull's volume, no convexity, and nothing said of being closed."""
    got = hulls.bounding_boxes(points, key).withColumn("watertight", F.lit(None).cast("boolean"))
    no = F.lit(False)
    done = geometry.bounding(got, F.lit(None).cast("double"), F.col("hull_volume"), no, no)
    return done.select(key, _box(done).alias("bounding"))


def planes(points: DataFrame, key: str) -> DataFrame:
    """key and planarity: the planes of each cloud (key, id, x, y, z), the largest hull first."""
    kind = _kind()["planarity"].dataType.elementType
    p = planesearch.search(points, key)
    one = _struct(kind, {"normal_xyz": F.col("normal"), "area_m2_est": F.round(F.col("area") * 1e-6, 4), "fit_rms_mm": F.round("rms", 3)})
    listed = F.transform(F.array_sort(F.collect_list(F.struct("plane", one.alias("p")))), lambda x: x["p"])
    return p.groupBy(key).agg(listed.alias("planarity")).withColumn("planarity", geometry.sorted_planes(F.col("planarity")))


def records(bounds: DataFrame, planarity: DataFrame | None = None, key: str = "fragment_id") -> DataFrame:
    """Records in the schema of `sources.records`, ready for the rules: bounding, planes (an empty list without any), the rest null."""
    both = bounds.withColumn("planarity", F.lit(None).cast(_kind()["planarity"].dataType)) if planarity is None else bounds.join(wide(planarity), key, "left")
    made = {"fragment_id": F.col(key).cast("string"), "bounding": F.col("bounding"), "planarity": F.coalesce("planarity", F.array().cast(_kind()["planarity"].dataType))}
    return both.select(*[made.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in _kind().fields])


def describe_meshes(tri: DataFrame, key: str, sample: int = SAMPLE) -> DataFrame:
    """Records of meshes (key, face, a, b, c, i, j, k): bounds, and planes found on points spread over the surface by area."""
    spread = surface.sample(tri, key, sample).select(key, F.col("at").alias("id"), "x", "y", "z")
    return records(mesh_bounds(tri, key), planes(spread, key), key)


def describe_clouds(points: DataFrame, key: str) -> DataFrame:
    """Records of clouds (key, id, x, y, z)."""
    return records(cloud_bounds(points, key), planes(points, key), key)
