"""What must not grow: broadcasts of growing sides, pairs of crowded tiles, hulls of few points."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardlake.operators import geometry, hulls, nearest, planesearch, raster, surface
from shardlake.plans import analytics, records, surfaces  # noqa: F401 - registers its queries

SF = "/root/testdata/sf0.001"


def watched(monkeypatch, module, check):
    plain = module.cut
    monkeypatch.setattr(module, "cut", lambda df: check(df) or plain(df))


def sent(df):
    """Whether a join of the plan sends a side through the driver."""
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_plane_search_sends_no_side_through_the_driver(spark, monkeypatch):
    seen = []
    watched(monkeypatch, planesearch, lambda df: seen.append(sent(df)))
    r = np.random.default_rng(0)
    rows = [(k % 2, k, float(x), float(y), 5.0) for k, (x, y) in enumerate(r.random((200, 2)) * 100)]
    assert planesearch.search(spark.createDataFrame(rows, "c long, id long, x double, y double, z double"), "c", 20).count() == 2
    assert seen and not any(seen)


def test_welds_and_loops_send_no_side_through_the_driver(spark, monkeypatch):
    seen = []
    watched(monkeypatch, surface, lambda df: seen.append(sent(df)))
    tri = spark.createDataFrame([(0, 0, 1, 2), (0, 0, 2, 3), (1, 0, 1, 2)], "mesh long, i long, j long, k long")
    got = surface.boundary_loops(tri, "mesh")
    assert sorted(map(tuple, got.collect())) == [(0, 0, k, k) for k in range(4)] + [(1, 0, k, k) for k in range(3)]
    at = spark.createDataFrame([(0, k, float(k), 0.0, 0.0) for k in range(4)], "mesh long, id long, x double, y double, z double")
    assert seen and not any(seen) and not sent(got) and not sent(geometry.weld(at, tri, "mesh", 1e-4))


def test_nearest_triangles_send_no_side_through_the_driver(spark, monkeypatch):
    """Blocks in many parts and in one give the same."""
    seen = []
    watched(monkeypatch, nearest, lambda df: seen.append(sent(df)))
    r = np.random.default_rng(6)
    rows = [(k, *[list(map(float, v)) for v in r.normal(size=(5, 3))]) for k in range(150)]
    t = spark.createDataFrame(rows, "id long, p array<double>, normal array<double>, a array<double>, b array<double>, c array<double>")
    ask, tri = t.select("id", "p", "normal"), t.select(F.col("id").alias("triangle"), "a", "b", "c")
    plain = nearest.nearest_triangle(ask, tri, 5)
    assert not sent(plain)
    want = sorted(map(tuple, plain.select("id", "triangle", "distance").collect()))
    monkeypatch.setattr(nearest, "POINTS", 20)
    monkeypatch.setattr(nearest, "SITES", 7)
    assert len(want) == 150 and sorted(map(tuple, nearest.nearest_triangle(ask, tri, 5).select("id", "triangle", "distance").collect())) == want
    assert seen and not any(seen)


def test_crowded_tiles_make_no_pairs(spark, monkeypatch):
    """600 tiles at one place: tables of the rounds have a row a tile at most."""
    sizes = []
    watched(monkeypatch, surface, lambda df: sizes.append(df.count()))
    tiles = spark.range(600).select(F.col("id").alias("k"), F.col("id").alias("o"), F.lit("a").alias("image"), (F.col("id") % 3).alias("x"), F.lit(0).alias("y"))
    assert [r.k for r in surface.spaced(tiles, "k", ["o"], 10).collect()] == [0]
    assert max(sizes) <= 600


def test_few_points_of_a_cloud_are_not_reduced(monkeypatch):
    calls, plain = [], hulls.corners
    monkeypatch.setattr(hulls, "corners", lambda p: calls.append(len(p)) or plain(p))
    xyz = np.random.default_rng(1).normal(size=(1500, 3))
    keys = [str(k) for k in range(100) for _ in range(5)] + ["big"] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(xyz[:, k].copy()) for k in range(3))], ["key", "x", "y", "z"])
    out = pa.Table.from_batches(list(hulls._reduced(iter([batch]))))
    assert calls == [1000] and 500 < len(out) < 800


def test_lines_are_grouped_once(spark):
    plan = records.with_regions(lambda n: spark.read.parquet(f"{SF}/{n}.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_reasons_are_left_out_only_where_asked(spark):
    from shardlake.operators import design

    rec = records.records(lambda n: spark.read.parquet(f"{SF}/{n}.parquet")).limit(50)
    both = [design.derive(rec, records.RULES, only=("design_assignment",), reasons=k).select(F.explode("planarity.procedural.design_assignment").alias("o")).select("o.value", "o.rule", "o.note", "o.reason").collect() for k in (True, False)]
    assert [r[:3] for r in both[0]] == [r[:3] for r in both[1]] and all(r.reason for r in both[0]) and not any(r.reason for r in both[1])


def test_runs_of_pixels(spark):
    """A ring, a run beside it, a mask of one pixel, pixels named twice; pixels without a mask are not linked."""
    ring = [("m", x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    px = spark.createDataFrame([*ring, *ring[:2], ("m", 5, 0), ("m", 6, 0), ("n", 4, 4), (None, 0, 0), (None, 1, 0)], "k string, x int, y int")
    got = {r.k: (r.pixels, r.coherence) for r in raster.coherence(px, "k").collect()}
    assert got == {"m": (10, 0.8), "n": (1, 1.0), None: (2, 0.5)}


@pytest.mark.parametrize("seed", [0, 1])
def test_masks_in_batches_are_spans(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(int(k % 3), *map(float, r.random(6) * 1.4 - 0.2)) for k in range(40)]
    tri = spark.createDataFrame(rows, "k int, u1 double, v1 double, u2 double, v2 double, u3 double, v3 double")
    px = [c.alias(f"{n}{k}") for k in (1, 2, 3) for c, n in zip(surface.pixel(F.col(f"u{k}"), F.col(f"v{k}"), 30, 20), "xy")]
    want = surface.union(surface.spans(tri.select("k", *px), ["k"], 30, 20), ["k"])
    assert sorted(map(tuple, surface.texture_mask(tri, "k", 30, 20).collect())) == sorted(map(tuple, want.collect()))


def test_masks_are_dealt_out_once(spark):
    """Images over many batches, one of very many triangles and null keys give the same spans; only triangles and one row an image are shuffled."""
    r = np.random.default_rng(7)
    rows = [(None if k % 9 == 0 else int(k % 3) if k % 4 else 5, *map(float, r.random(6) * 1.2 - 0.1)) for k in range(400)]
    tri = spark.createDataFrame(rows, "k int, u1 double, v1 double, u2 double, v2 double, u3 double, v3 double")
    px = [c.alias(f"{n}{k}") for k in (1, 2, 3) for c, n in zip(surface.pixel(F.col(f"u{k}"), F.col(f"v{k}"), 30, 20), "xy")]
    want = surface.union(surface.spans(tri.select("k", *px), ["k"], 30, 20), ["k"])
    want = sorted(map(tuple, want.collect()), key=repr)
    for size in ("7", "100", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(tuple, surface.texture_mask(tri, "k", 30, 20).collect()), key=repr) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(surface.texture_mask(tri, "k", 30, 20)).count("Exchange") == 1
    assert plan(analytics.QUERIES["uv_mask"](spark, SF)).count("Exchange") == 2


def test_a_refresh_makes_the_records_once(spark, tmp_path):
    from shardlake.operators import design
    from shardlake.sources import refresh as store

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    plain = records.records(lambda n: spark.read.parquet(f"{SF}/{n}.parquet")).limit(60).localCheckpoint()
    derive = lambda rows, rules: design.derive(rows, rules, only=("handling_class", "use_suggestions"))
    run = lambda df: store.refresh(df.mapInArrow(counted, df.schema), f"{tmp_path}/store", records.RULES, derive).groupBy("state").count().collect()
    number = F.col("fragment_id").cast("long")
    mass = F.when(number % 2 == 0, 0.5).otherwise(F.col("bounding.mass_kg_est"))
    later = plain.filter(number % 5 != 0).withColumn("bounding", F.col("bounding").withField("mass_kg_est", mass))
    for df, rows in ((plain, 60), (later, later.count()), (later, later.count())):
        made.value = 0
        run(df)
        assert made.value == rows


def test_what_joins_records_by_name_does_not_move_them(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rec = records.records(lambda n: spark.read.parquet(f"{SF}/{n}.parquet"))
        slim = spark.range(10).select(F.format_string("%012d", "id").alias("fragment_id"))
        plan = rec.join(slim, "fragment_id")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3  # lines, orders and the slim side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
