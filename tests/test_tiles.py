"""Windows over tiles against the whole image by plain loops; the same for every size of tile."""

from __future__ import annotations

import numpy as np
import pytest

from shardlake.operators import tiles


def flood(mask):
    """Blobs by flood filling."""
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not label[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                    label[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return label


def same(a, b):
    return len(set(zip(a.ravel(), b.ravel()))) == len(set(a.ravel())) == len(set(b.ravel())) and ((a == 0) == (b == 0)).all()


def test_labels():
    r = np.random.default_rng(1)
    for share in (0.3, 0.5, 0.6, 0.9, 1.0, 0.0):
        m = r.random((23, 31)) < share
        assert same(tiles.labelled(m), flood(m))
    spiral = np.zeros((41, 41), bool)
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = True
    assert same(tiles.labelled(spiral), flood(spiral))


def plain(grey, valid, smear, flat):
    """Both shares of a whole image, windows by loops over their places."""
    h, w = grey.shape
    mirror = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    near = lambda a, y, x, k: [int(a[mirror(y + i, h), mirror(x + j, w)]) for i in range(-(k // 2), k // 2 + 1) for j in range(-(k // 2), k // 2 + 1)]
    each = lambda f: np.array([[f(y, x) for x in range(w)] for y in range(h)])
    cells = lambda m, y, x, k: [0 <= y + i < h and 0 <= x + j < w and bool(m[y + i, x + j]) for i in range(-(k // 2), k // 2 + 1) for j in range(-(k // 2), k // 2 + 1)]
    tidy = lambda m, o, c: (lambda a: (lambda b: (lambda d: each(lambda y, x: all(cells(d, y, x, c))))(each(lambda y, x: any(cells(b, y, x, c)))))(each(lambda y, x: any(cells(a, y, x, o)))))(each(lambda y, x: all(cells(m, y, x, o))))
    weight = [[1, 0, -1], [2, 0, -2], [1, 0, -1]]
    dx = each(lambda y, x: -sum(weight[i][j] * v for (i, j), v in zip([(i, j) for i in range(3) for j in range(3)], near(grey, y, x, 3))))
    dy = each(lambda y, x: -sum(weight[j][i] * v for (i, j), v in zip([(i, j) for i in range(3) for j in range(3)], near(grey, y, x, 3))))

    def coherent(y, x):
        a, b, c = (sum(near(v, y, x, smear[0])) for v in (dx * dx, dy * dy, dx * dy))
        return a + b > 0 and ((a - b) ** 2 + 4 * c * c) ** 0.5 > 0.65 * (a + b) and valid[y, x]

    s = tidy(each(coherent), *smear[1:])
    rest = flood(~s)
    edge = set(rest[0]) | set(rest[-1]) | set(rest[:, 0]) | set(rest[:, -1])
    s = s | ((rest > 0) & ~np.isin(rest, list(edge)))
    f = tidy(each(lambda y, x: np.std(near(grey, y, x, flat[0])) < 3.0 and valid[y, x]), *flat[1:])
    out = []
    for m in (s, f):
        label = flood(m)
        big = [k for k in range(1, label.max() + 1) if (label == k).sum() > 0.02 * max(valid.sum(), 1)]
        out.append((np.isin(label, big) & valid).sum() / valid.sum() if valid.sum() else None)
    return int(valid.sum()), *out


def picture(seed, h=45, w=52):
    """Noise with a smeared ring around a noisy hole, a flat patch, specks of both and parts that are not valid."""
    r = np.random.default_rng(seed)
    g = r.integers(0, 255, (h, w))
    for x in range(8, 40):
        g[6:36, x] = (x * 5 * (1 + seed)) % 250
    g[14:24, 16:28] = r.integers(0, 255, (10, 12))
    g[30:44, 30:50] = 90 + r.integers(0, 3, (14, 20))
    v = np.ones((h, w), bool)
    v[: 5 + seed, :9] = False
    v[20:22, 33:50] = False
    return g.astype(np.uint8), v


@pytest.mark.parametrize("size", [9, 16, 64])
def test_tiles_give_the_whole_image(spark, size):
    smear, flat = (3, 3, 5), (3, 3, 3)
    rows, want = [], {}
    for seed in (0, 1):
        g, v = picture(seed)
        rows.append((seed, 52, 45, bytearray(g.tobytes()), bytearray(v.astype(np.uint8).tobytes())))
        want[seed] = plain(g, v, smear, flat)
    rows += [(5, 52, 45, bytearray(b"12"), bytearray(b"12")), (6, None, None, None, None), (7, 3, 2, bytearray(6), bytearray(6)), (8, 4, 4, bytearray(b"\x50" * 16), bytearray(b"\1" * 16))]
    images = spark.createDataFrame(rows, "k int, width int, height int, grey binary, mask binary")
    got = {r.k: (r.valid, r.smear, r.flat) for r in tiles.shares(tiles.tiled(images, "k", size), "k", size, smear, flat).collect()}
    assert set(got) == {0, 1, 7, 8} and got[7] == (0, None, None) and got[8] == (16, 0.0, 0.25)  # closing takes the rim, as outside is nothing
    for k, x in want.items():
        assert got[k][0] == x[0] and np.allclose(got[k][1:], x[1:]) and 0.1 < x[1] < 0.9 and 0.05 < x[2] < 0.5
    with pytest.raises(ValueError):
        tiles.shares(tiles.tiled(images, "k", 4), "k", 4, smear, flat)
