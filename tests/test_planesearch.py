"""Planes of many clouds at once against the search of one cloud in memory."""

import duckdb
import numpy as np

from shardlake.operators import kernels, planesearch
from shardlake.plans import analytics, surfaces  # noqa: F401 - registers its queries


def test_the_same_planes_as_one_cloud_in_memory(spark):
    r = np.random.default_rng(1)
    floor = np.column_stack([r.random((900, 2)) * 1000, r.normal(0, 0.4, 900)])
    wall = np.column_stack([r.normal(0, 0.4, 500), r.random(500) * 1000, 20 + r.random(500) * 480])
    noise = r.random((12, 3)) * 900 + 60
    corner = np.vstack([floor, wall, noise])
    turn = np.linalg.qr(r.normal(size=(3, 3)))[0]
    clouds = {"a": corner, "b": corner @ turn.T + [500, -300, 70], None: floor, "two": floor[:2], "line": np.outer(np.arange(40), [1.0, 2.0, 3.0])}
    rows = [(k, n, *map(float, p)) for k, c in clouds.items() for n, p in enumerate(c)] + [("a", 5000, None, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "mesh string, id long, x double, y double, z double")
    found = planesearch.search(table, "mesh", 60)
    got = {(g.mesh, g.plane): g for g in found.collect()}
    assert {k for k, _ in got} == {"a", "b", None}
    for k in ("a", "b", None):
        want = kernels.find_planes(clouds[k], tries=300)
        mine = [got[k, n] for n in range(len(want))]
        assert (k, len(want)) not in got
        for w, g in zip(want, mine):
            assert abs(np.dot(w["normal"], g.normal)) > 0.9999 and abs(abs(w["d"]) - abs(g.d)) < 1.5 and abs(w["inliers"] - g.inliers) <= 0.03 * w["inliers"]
            assert abs(w["area_m2"] * 1e6 - g.area) < 0.03 * g.area and abs(w["rms_mm"] - g.rms) < 0.1 and abs(g.fraction - g.inliers / len(clouds[k])) < 1e-9
    again = {(g.mesh, g.plane): (g.inliers, round(g.d, 6)) for g in planesearch.search(table.repartition(13), "mesh", 60).collect()}
    assert again == {k: (g.inliers, round(g.d, 6)) for k, g in got.items()}
    assert planesearch.search(table.limit(0), "mesh").count() == 0


def test_clouds_with_bad_luck_try_on(spark):
    """200 clouds of three levels, 60 points on the largest: of twenty planes none lies on it in some clouds, where a slanted plane would be the best."""
    r = np.random.default_rng(3)
    level = np.repeat([50.0, 150.0, 300.0], [60, 36, 24])
    rows = [(c, n, *map(float, (*r.integers(0, 200, 2) * 10, z))) for c in range(200) for n, z in enumerate(level)]
    got = planesearch.search(spark.createDataFrame(rows, "c long, id long, x double, y double, z double"), "c", 20)
    found = {}
    for g in got.collect():
        found.setdefault(g.c, []).append((round(abs(g.d)), g.inliers))
    assert len(found) == 200 and all(sorted(v) == [(50, 60), (150, 36), (300, 24)] for v in found.values())


def test_shares_are_rounded_as_sql_does(spark, tmp_path):
    """333 / 640 lies between two sixth places: by its digits it would be rounded up."""
    r = np.random.default_rng(4)
    quantity = np.repeat([10.0, 30.0, 45.0], [333, 187, 120])
    rows = [(int(k), int(r.integers(0, 20000)), 7, float(q)) for k, q in enumerate(quantity)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = duckdb.sql(analytics.SQL["planes_of_clouds"].replace("lineitem", f"'{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    got = analytics.QUERIES["planes_of_clouds"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want) and (7, 50, 333, 0.520312) in want
