"""Checks of meshes before they are described: python -m shardlake.preflight FOLDER [--records FOLDER] [--texture PX]. Exit 1 if anything fails or nothing is there."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlake.operators import describe, findings, geometry, surface
from shardlake.reports import table
from shardlake.sources import mesh, records


def measured(tri: DataFrame, texture: int) -> DataFrame:
    """What the checks read of each mesh: fragment_id, faces, dims, longest_mm, volume, hull, consistent, has_uv, density (px a mm; null without UV)."""
    key = "fragment_id"
    sums = geometry.totals(tri, key).select(key, "faces", "volume", F.col("area").alias("area_mm2"))
    flat = tri.select(key, *[F.col(c)[n].alias(f"{v}{k}") for k, c in enumerate(("ua", "ub", "uc"), 1) for n, v in enumerate("uv")])
    seen = flat.groupBy(key).agg(F.max(F.col("u1").isNotNull()).alias("has_uv")).join(surface.uv_area(flat, key), key)
    hull = describe.mesh_sums(tri, key).select(key, "hull_volume", "obb_dims_mm", "consistent")
    both = sums.join(seen, key).join(hull, key).withColumn("atlas_px", F.lit(texture))
    both = geometry.texel_density(both).withColumn("density", F.when(F.col("has_uv"), F.col("density")))
    return both.select(key, "faces", F.col("obb_dims_mm").alias("dims"), F.col("obb_dims_mm")[0].alias("longest_mm"), "volume", F.col("hull_volume").alias("hull"), "consistent", "has_uv", "density")


def checks(meshes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """All findings on measured meshes, worst first; with the records of an earlier run, fragments that have changed too."""
    found = [findings.remesh(meshes), findings.uv(meshes), findings.volume(meshes), findings.texel_density(meshes), findings.duplicates(meshes)]
    if stored is not None:
        found.append(findings.drift(meshes.select("fragment_id", "dims"), stored.select("fragment_id", F.col("bounding.obb_dims_mm").alias("dims"))))
    return findings.collect(*found)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="shardlake.preflight", description=__doc__)
    p.add_argument("folder")
    p.add_argument("--records")
    p.add_argument("--texture", type=int, default=4096)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("shardlake").getOrCreate()
    inputs = mesh.sources(spark, a.folder)
    tri = mesh.read_meshes(spark, a.folder).join(inputs, "path")
    if tri.isEmpty():
        print("no meshes", file=sys.stderr)
        return 1
    stored = records.read_records(spark, a.records, "*_geometry.json") if a.records else None
    rows = checks(measured(tri, a.texture), stored).select("level", "fragment_id", "title", "detail").collect()  # a few lines a mesh
    print("\n".join(table(("level", "fragment", "check", "detail"), [tuple(r) for r in rows])))
    return int(any(r.level == "fail" for r in rows))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
