"""Plane search, hulls and pixel windows on shapes whose answer is known."""

import numpy as np

from shardlake.operators import kernels


def test_planes_of_a_box_corner(spark):
    r = np.random.default_rng(1)
    floor = np.column_stack([r.random((3000, 2)) * 1000, r.normal(0, 0.5, 3000)])
    wall = np.column_stack([r.normal(0, 0.5, 1500), r.random((1500, 2)) * 500])
    rows = [("a", i, *map(float, p)) for i, p in enumerate(np.vstack([floor, wall]))] + [("b", 0, 0.0, 0.0, 0.0)]
    got = kernels.planes(spark.createDataFrame(rows, "mesh string, id long, x double, y double, z double"), "mesh", tries=60).sort("plane").collect()
    assert [(g.mesh, g.plane) for g in got[:2]] == [("a", 0), ("a", 1)] and {g.mesh for g in got} == {"a"}
    assert abs(got[0].normal[2]) > 0.999 and abs(got[0].area_m2 - 1.0) < 0.05 and got[0].rms_mm < 1.0 and got[0].inliers >= 2990
    assert abs(got[1].normal[0]) > 0.999 and abs(got[1].area_m2 - 0.25) < 0.02


def test_hull_and_sampling():
    assert kernels.hull_area(np.array([[0, 0], [2, 0], [2, 1], [0, 1], [1, 0.5], [0, 0]])) == 2.0
    assert kernels.hull_area(np.array([[0, 0], [1, 1], [2, 2]])) is None and kernels.hull_area(np.zeros((5, 2))) is None
    a, b, c = (np.array(x, float) for x in ([[0, 0, 0], [5, 0, 0]], [[1, 0, 0], [5, 0, 0]], [[0, 1, 0], [5, 0, 0]]))
    p = kernels.sample_surface(a, b, c, 500)
    assert (p.sum(1) <= 1 + 1e-9).all() and (p >= 0).all() and (p == kernels.sample_surface(a, b, c, 500)).all()
    assert len(kernels.sample_surface(a[1:], b[1:], c[1:], 5)) == 0


def test_pixel_windows():
    m = np.zeros((40, 40), bool)
    m[10:30, 10:30] = True
    m[2, 2] = True
    m[20, 20] = False
    assert not kernels.opened(m, 3)[2, 2] and kernels.closed(m, 3)[20, 20] and kernels.odd(10, 0.4) == 5 and kernels.odd(0.1, 1) == 3
    assert kernels.largest_only(m, 10).sum() == 399 and len(np.unique(kernels.blobs(m))) == 3
    mask = kernels.region_mask(40, 40, np.array([[0.5, 0.5], [0.55, 0.5], [2.0, 2.0]]))
    assert mask[20, 20] and mask[20, 24] and not mask[5, 5]


def test_smear_and_flat(spark):
    r = np.random.default_rng(2)
    noise = r.integers(0, 255, (60, 60)).astype(np.uint8)
    stripes = np.tile((np.arange(60) * 4 % 256).astype(np.uint8), (60, 1))
    plain = np.full((60, 60), 90, np.uint8)
    full = np.ones((60, 60), np.uint8)
    rows = [(n, 60, 60, bytearray(g.tobytes()), bytearray(full.tobytes())) for n, g in (("noise", noise), ("stripes", stripes), ("plain", plain))]
    rows += [("odd", 7, 60, bytearray(b"12"), bytearray(b"12")), ("none", 60, 60, bytearray(plain.tobytes()), bytearray(bytes(3600))), ("null", None, None, None, None)]
    got = {x.k: x for x in kernels.texture_metrics(spark.createDataFrame(rows, "k string, width int, height int, grey binary, mask binary"), "k").collect()}
    assert got["noise"].smear < 0.1 and got["noise"].flat == 0 and got["stripes"].smear > 0.9 and got["plain"].flat == 1 and got["plain"].smear == 0
    assert got["odd"].valid is None and (got["none"].valid, got["none"].smear) == (0, None) and got["null"].flat is None
