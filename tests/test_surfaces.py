"""Hulls, boxes, nearest neighbours, sampling, pixel rows, loops and spacing against brute force, with odd rows."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlake.operators import hulls, nearest, surface


def floats(*points):
    return [[float(v) for v in p] for p in points]


def outside(p, q, faces):
    """How far any point of p lies beyond the hull's planes."""
    n = np.cross(q[faces[:, 1]] - q[faces[:, 0]], q[faces[:, 2]] - q[faces[:, 0]])
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    return float((p @ n.T - (n * q[faces[:, 0]]).sum(1)).max())


@pytest.mark.parametrize("mode", ["normal", "lattice", "thin", "repeated"])
def test_hull_of_random_clouds(mode):
    """All points lie within, the surface is closed (Euler), and hulls of parts merge to the hull of the whole."""
    r = np.random.default_rng(hash(mode) % 100)
    for _ in range(40):
        n = int(r.integers(8, 60))
        p = {"normal": r.normal(size=(n, 3)), "lattice": r.integers(0, 4, (n, 3)).astype(float), "thin": r.random((n, 3)) * [100, 1, 0.01], "repeated": np.repeat(r.normal(size=(n, 3)), 3, 0)}[mode]
        at, faces = hulls.corners(p)
        if not len(faces):
            continue
        sides = {frozenset(e) for f in faces.tolist() for e in itertools.combinations(f, 2)}
        assert outside(p, p, faces) < 1e-7 and len(np.unique(faces)) - len(sides) + len(faces) == 2
        half = len(p) // 2
        q = p[np.concatenate([hulls.corners(p[:half])[0], half + hulls.corners(p[half:])[0]])]
        assert math.isclose(hulls.volume(q, hulls.corners(q)[1]), hulls.volume(p, faces), rel_tol=1e-9)


def test_boxes_of_turned_and_flat_clouds():
    r = np.random.default_rng(7)
    for _ in range(20):
        dims = np.sort(r.random(3) * 10 + 1)[::-1]
        q = np.linalg.qr(r.normal(size=(3, 3)))[0]
        unit = np.concatenate([np.array(list(itertools.product((0, 1), repeat=3))), r.random((50, 3))])
        p = unit * dims @ q.T + r.normal(size=3)
        got, axes = hulls.box(p, hulls.corners(p)[1])
        assert np.allclose(got, dims) and np.allclose(np.abs(axes @ q), np.eye(3), atol=1e-6)
    tetra = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    assert np.isclose(hulls.volume(tetra, hulls.corners(tetra)[1]), 1 / 6)
    square = np.array([[0, 0, 5], [2, 0, 5], [2, 3, 5], [0, 3, 5], [1, 1, 5.0], [2, 0, 5]])
    at, faces = hulls.corners(square)
    assert sorted(at.tolist()) == [0, 1, 2, 3] and not len(faces) and np.allclose(hulls.box(square, faces)[0], [3, 2, 0])
    line = np.array([[0, 0, 0], [1, 1, 1], [3, 3, 3.0]])
    assert sorted(hulls.corners(line)[0].tolist()) == [0, 2] and np.allclose(hulls.box(line, hulls.corners(line)[1])[0], [math.sqrt(27), 0, 0])
    assert hulls.corners(np.ones((4, 3)))[0].tolist() == [0]


def test_hulls_of_a_table(spark, monkeypatch):
    """One cloud over many tasks and merges, a flat one, one point, a null key, null and infinite coordinates, an extra column."""
    r = np.random.default_rng(3)
    cloud = r.normal(size=(3000, 3))
    rows = [("big", *map(float, p)) for p in cloud] + [("flat", float(x), float(y), 0.0) for x in range(3) for y in range(3)] + [("one", 1.0, 2.0, 3.0)] * 2
    rows += [(None, *map(float, p)) for p in itertools.product((0, 1), repeat=3)] + [("big", None, 0.0, 0.0), ("big", math.inf, 0.0, 0.0), ("gone", math.nan, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "cloud string, x double, y double, z double").withColumns({"key": F.lit("clash"), "salt": F.lit("clash")}).repartition(40)
    monkeypatch.setattr(hulls, "FAN", 2)
    got = {r.cloud: r for r in hulls.bounding_boxes(table, "cloud").collect()}
    assert set(got) == {"big", "flat", "one", None}
    assert math.isclose(got["big"].hull_volume, hulls.volume(cloud, hulls.corners(cloud)[1]), rel_tol=1e-9)
    assert (got["flat"].hull_volume, got["flat"].hull_points) == (0.0, 4) and np.allclose(got["flat"].obb_dims_mm, [2, 2, 0])
    assert got["one"].obb_dims_mm == [0.0, 0.0, 0.0] and math.isclose(got[None].hull_volume, 1.0)
    assert hulls.bounding_boxes(table.limit(0), "cloud").count() == 0


def test_nearest_against_all_pairs(spark):
    """Crowded places, far points, ties; any first width of cells gives the same."""
    r = random.Random(5)
    sites = [(k, *[float(r.choice([0, 0, 1, 2, 50])) + (r.random() if k % 3 else 0) for _ in range(3)]) for k in range(300)] + [(1000 + k, 1.0, 1.0, 1.0) for k in range(200)]
    points = [(k, *[r.random() * 3 for _ in range(3)]) for k in range(60)] + [(100, 1.0, 1.0, 1.0), (100, 1.0, 1.0, 1.0), (101, 900.0, -900.0, 5.0), (102, None, 0.0, 0.0), (None, 2.0, 2.0, 2.0)]
    s, p = spark.createDataFrame([*sites, (5000, math.nan, 0.0, 0.0)], "site long, x double, y double, z double"), spark.createDataFrame(points, "id long, x double, y double, z double")
    want = sorted(((i, n + 1, *x) for i, *at in points if at[0] is not None for n, x in enumerate([(j, d) for d, j in sorted((math.dist(at, place), j) for j, *place in sites)[:7]])), key=repr)
    for size in (None, 2.0):
        got = sorted((tuple(r) for r in nearest.nearest(p, s, 7, size).select("id", "rank", "site", "distance").collect()), key=repr)
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert nearest.nearest(p, s.limit(0), 7).count() == 0 and nearest.nearest(p.limit(0), s, 7).count() == 0
    assert nearest.nearest(p.filter("id = 101"), s.filter("site < 3"), 7).count() == 3


def test_closest_place_on_triangles(spark):
    """Against a fine search over the triangle; triangles without area are their sides; facing ones come first."""
    r = np.random.default_rng(2)
    grid = [(i / 60, j / 60) for i in range(61) for j in range(61 - i)]
    rows = [(k, *[[float(v) for v in r.normal(size=3)] for _ in range(4)]) for k in range(40)] + [(90, [0.0, 1.0, 0.0], [0.0] * 3, [2.0, 0.0, 0.0], [4.0, 0.0, 0.0]), (91, [0.0, 1.0, 0.0], [0.0] * 3, [0.0] * 3, [0.0] * 3)]
    t = spark.createDataFrame(rows, "id long, p array<double>, a array<double>, b array<double>, c array<double>")
    for x in t.withColumn("at", nearest.closest_on_triangle(F.col("p"), F.col("a"), F.col("b"), F.col("c"))).collect():
        p, a, b, c = (np.array(v) for v in (x.p, x.a, x.b, x.c))
        d = np.linalg.norm(p - (x.at.u * a + x.at.v * b + x.at.w * c))
        best = min(np.linalg.norm(p - ((1 - v - w) * a + v * b + w * c)) for v, w in grid)
        assert best - 0.12 <= d <= best + 1e-9 and min(x.at.u, x.at.v, x.at.w) >= -1e-9
    tri = spark.createDataFrame([(1, *floats((0, 0, 0), (1, 0, 0), (0, 1, 0))), (2, *floats((0, 0, 0.1), (0, 1, 0.1), (1, 0, 0.1)))], "triangle long, a array<double>, b array<double>, c array<double>")
    ask = spark.createDataFrame([(7, *floats((0.2, 0.2, 0.09), (0, 0, 1))), (8, *floats((0.2, 0.2, 0.09), (0, 0, -1))), (9, *floats((0.2, 0.2, 0.09), (1, 0, 0)))], "id long, p array<double>, normal array<double>")
    got = {x.id: (x.triangle, round(x.distance, 6), x.facing) for x in nearest.nearest_triangle(ask, tri).collect()}
    assert got == {7: (1, 0.09, True), 8: (2, 0.01, True), 9: (2, 0.01, False)}


def crossing(y, p, q):
    (px, py), (qx, qy) = p, q
    if not min(py, qy) <= y <= max(py, qy):
        return []
    return [px, qx] if py == qy else [px + (y - py) * ((qx - px) / (qy - py))]


def test_pixel_rows_against_every_pixel(spark):
    """Triangles inside, across and beyond the image, flat ones, single pixels; spans that touch are one."""
    r = random.Random(8)
    tri = [(k % 5, *[r.choice([r.uniform(-0.3, 1.3), r.randint(0, 2) / 2]) for _ in range(6)]) for k in range(60)] + [(6, *[0.5] * 6), (7, *[None] * 6)]
    t = spark.createDataFrame(tri, "image long, u1 double, v1 double, u2 double, v2 double, u3 double, v3 double")
    want = set()
    for image, *uv in tri:
        if uv[0] is not None:
            at = [(math.floor(min(max(u, 0), 1) * 20), math.floor((1 - min(max(v, 0), 1)) * 16)) for u, v in zip(uv[::2], uv[1::2])]
            for y in range(16):
                x = [v for p, q in ((0, 1), (1, 2), (2, 0)) for v in crossing(y, at[p], at[q])]
                want |= {(image, y, k) for k in range(20) if x and math.floor(min(x) + 0.5) <= k <= math.ceil(max(x) - 0.5)}
    rows = surface.texture_mask(t, "image", 20, 16)
    assert {(p.image, p.y, p.x) for p in surface.pixels(rows).collect()} == want and (6, 8, 10) in want
    spans = sorted((s.image, s.y, s.x0, s.x1) for s in rows.collect())
    assert all(a[:2] != b[:2] or a[3] + 1 < b[2] for a, b in zip(spans, spans[1:]))


def test_sampling_is_the_same_for_any_partitioning(spark):
    """Each triangle's points to within one of its share, for one large mesh and small ones; null corners and no area give none."""
    r = np.random.default_rng(4)
    rows = [("big", k, *[[float(v) for v in r.normal(size=3)] for _ in range(3)]) for k in range(400)] + [("small", 1, *floats((0, 0, 0), (1, 0, 0), (0, 1, 0))), ("flat", 1, *floats((0, 0, 0), (1, 0, 0), (2, 0, 0))), ("big", 999, None, None, None), (None, 3, *floats((0, 0, 0), (1, 0, 0), (0, 1, 0)))]
    t = spark.createDataFrame(rows, "mesh string, face long, a array<double>, b array<double>, c array<double>")
    seen = []
    for n in (1, 3, 11):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        seen.append(sorted((tuple(x) for x in surface.sample(t.repartition(n), "mesh", 1000).collect()), key=repr))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and {x[0] for x in seen[0]} == {"big", "small", None}
    area = {k: np.linalg.norm(np.cross(np.subtract(b, a), np.subtract(c, a))) / 2 for m, k, a, b, c in rows if m == "big" and a}
    for k, v in area.items():
        assert abs(sum(x[:2] == ("big", k) for x in seen[0]) - 1000 * v / sum(area.values())) <= 1
    assert sorted(x[2] for x in seen[0] if x[0] == "big") == list(range(1000))


def test_loops_around_holes(spark):
    """A band of squares with two holes that touch at a corner; a closed mesh has none; each loop runs along open edges."""
    cells = {(x, y) for x in range(6) for y in range(5)} - {(1, 1), (2, 2), (4, 3)}
    tri = [("sheet", *[(y + j) * 10 + x + i for i, j in c]) for x, y in cells for c in (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))]
    tri += [("tetra", *c) for c in ((0, 1, 2), (0, 2, 3), (0, 3, 1), (1, 3, 2))]
    half = {(m, e) for m, i, j, k in tri for e in ((i, j), (j, k), (k, i))}
    open_ = {(m, e) for m, e in half if (m, e[::-1]) not in half}
    t = spark.createDataFrame(tri, "mesh string, i long, j long, k long")
    rings: dict = {}
    for x in surface.boundary_loops(t, "mesh").collect():
        rings.setdefault((x.mesh, x.loop), {})[x.place] = x.vertex
    walked = [(m, (ring[k], ring[(k + 1) % len(ring)])) for (m, _), ring in rings.items() for k in sorted(ring)]
    assert sorted(walked) == sorted(open_) and {m for m, _ in rings} == {"sheet"} and 3 <= len(rings) <= 4
    assert all(sorted(ring) == list(range(len(ring))) for ring in rings.values())
    assert surface.boundary_loops(t.filter("mesh = 'tetra'"), "mesh").count() == 0


def test_spacing_is_the_loop(spark):
    r = random.Random(6)
    tiles = [(k, f"i{r.randrange(3)}", r.randrange(400), r.randrange(400), r.randrange(9)) for k in range(250)] + [(900, None, 1, 1, 1), (901, "i0", None, 1, 1)]
    t = spark.createDataFrame(tiles, "k long, image string, x long, y long, p long")
    taken: list = []
    for k, image, x, y, p in sorted((v for v in tiles if None not in v), key=lambda v: (v[4], v[0])):
        if all(image != i or abs(x - a) >= 60 or abs(y - b) >= 60 for _, i, a, b in taken):
            taken.append((k, image, x, y))
    assert sorted(v.k for v in surface.spaced(t, "k", ["p"], 60).collect()) == sorted(v[0] for v in taken)
    assert surface.spaced(t.limit(0), "k", ["p"], 60).count() == 0


def test_label_tiles(spark):
    """Lit enough, no pixel shared with used ones, half a side apart, the first n by number; sides follow the density; images that are too small or odd give none."""
    r = np.random.default_rng(1)
    a, b = (r.random((90, 70)) < 0.97).astype(np.uint8) * 200, np.zeros((60, 60), np.uint8)
    a[:, :20] = 0
    rows = [("a", 70, 90, 2.0, bytearray(a.tobytes())), ("dark", 60, 60, 1.0, bytearray(b.tobytes())), ("small", 5, 5, 1.0, bytearray(25)), ("odd", 9, 90, 1.0, bytearray(3)), ("null", None, 60, None, None)]
    images = spark.createDataFrame(rows, "image string, width int, height int, density double, bright binary")
    found = surface.candidates(images, 300, 8.0, 6, 40)
    seen = found.collect()
    assert {x.image for x in seen} == {"a", "dark"} and {x.side for x in seen if x.image == "a"} == {16} and {x.share for x in seen if x.image == "dark"} == {0.0}
    assert all(math.isclose(x.share, (a[x.y : x.y + 16, x.x : x.x + 16] > 18).mean()) for x in seen if x.image == "a")
    used = spark.createDataFrame([("a", 30, 40), ("other", 1, 1)], "image string, x int, y int")
    got = sorted((x.at, x.x, x.y) for x in surface.label_tiles(found, 6, used).collect())
    want: list = []
    for x in sorted((x for x in seen if x.image == "a" and x.share >= 0.9), key=lambda x: x.at):
        if len(want) < 6 and not (abs(x.x - 30) < 16 and abs(x.y - 40) < 16) and all(abs(x.x - p) >= 8 or abs(x.y - q) >= 8 for _, p, q in want):
            want.append((x.at, x.x, x.y))
    assert got == want and len(want) == 6
    assert surface.label_tiles(surface.candidates(images.limit(0), 10, 8.0, 6, 40), 6).count() == 0
