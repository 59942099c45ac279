"""From files to records: closed, split and open meshes, a cloud; the rules run on what comes out."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardlake.operators import describe, design
from shardlake.plans.records import RULES
from shardlake.sources import mesh
from shardlake.sources.records import SCHEMA

SIDES = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]


def box(path, dims, split=False, sides=6):
    """A box as an OBJ file; split: every side has corners of its own, as along seams."""
    corner = [[d * v for d, v in zip(dims, c)] for c in itertools.product((0, 1), repeat=3)]
    lines, faces = [], []
    for side in SIDES[:sides]:
        if split:
            faces.append([len(lines) + n + 1 for n in range(4)])
            lines += [corner[n] for n in side]
        else:
            faces.append([n + 1 for n in side])
    lines = lines or corner
    path.write_text("".join(f"v {x} {y} {z}\n" for x, y, z in lines) + "".join("f " + " ".join(map(str, f)) + "\n" for f in faces))


def test_meshes_and_clouds_to_records(spark, tmp_path):
    box(tmp_path / "whole.obj", (1000, 400, 100))
    box(tmp_path / "seams.obj", (1000, 400, 100), split=True)
    box(tmp_path / "open.obj", (1000, 400, 100), sides=5)
    name = F.regexp_extract("path", "([^/]+)\\.obj$", 1)
    tri = mesh.read_meshes(spark, str(tmp_path)).withColumn("fragment_id", name)
    got = describe.describe_meshes(tri, "fragment_id", 3000)
    assert got.schema.simpleString() == StructType.fromDDL(SCHEMA).simpleString()
    rows = {r.fragment_id: r for r in got.collect()}
    for n in ("whole", "seams"):
        b = rows[n].bounding
        assert (b.volume_source, b.volume_mm3, b.convexity, b.mass_kg_est, b.watertight) == ("mesh", 4e7, 1.0, 100.0, True)
        assert b.obb_dims_mm == [1000.0, 400.0, 100.0] and np.allclose(np.abs(b.obb_axes_xyz), np.eye(3))
        areas = [p.area_m2_est for p in rows[n].planarity]
        assert len(areas) >= 4 and areas == sorted(areas, reverse=True) and abs(areas[0] - 0.4) < 0.02
    assert rows["open"].bounding.watertight is False and rows["open"].bounding.volume_source in ("mesh_nearly_closed", "convex_hull")
    after = {r.fragment_id: r for r in design.derive(got, RULES).select("fragment_id", F.col("procedural.handling_class.value").alias("h"), F.size("planarity").alias("n")).collect()}
    assert after["whole"].h == "manual" and after["whole"].n == len(rows["whole"].planarity)

    r = np.random.default_rng(2)
    cloud = [("c", k, *map(float, p)) for k, p in enumerate(np.concatenate([np.array(list(itertools.product((0, 1), repeat=3))), r.random((400, 3))]) * [500, 300, 200])]
    one = describe.records(describe.cloud_bounds(spark.createDataFrame(cloud, "fragment_id string, id long, x double, y double, z double"), "fragment_id")).first()
    assert (one.bounding.volume_source, one.bounding.convexity, one.bounding.watertight, one.planarity) == ("convex_hull", None, None, [])
    assert one.bounding.volume_mm3 == 3e7 and one.bounding.mass_kg_est == 75.0 and one.bounding.obb_dims_mm == [500.0, 300.0, 200.0]
    assert describe.mesh_bounds(tri.limit(0), "fragment_id").count() == 0
