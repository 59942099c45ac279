"""Pixel windows over tiled images: a large image is many tasks, and its results do not depend on the tiles.

Tiles get a halo from their neighbours, as wide as the windows look. Blobs are labelled by runs inside a tile; across tiles they are components of a
graph of labels, so that neither a blob nor an image is ever one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlake.operators.graph import connected_components, cut

# Coherence above which a patch is smeared, deviation under which it is flat, least share of the valid pixels for a blob; windows in pixels
# (window, opening, closing) where no density is known.
COHERENT, FLAT_SD, BLOB = 0.65, 3.0, 0.02
SMEAR, FLAT = (9, 5, 25), (15, 9, 21)


def window_sums(a: np.ndarray, k: int, mode: str = "symmetric") -> np.ndarray:
    """Sums over windows of odd width k, in whole numbers: the same wherever the array begins. Edges mirror, or count as nothing with mode `constant`."""
    h = k // 2
    a = np.pad(a.astype(np.int64), h, mode=mode)
    for axis in (0, 1):
        c = np.cumsum(a, axis=axis)
        c = np.concatenate([np.zeros_like(np.take(c, [0], axis)), c], axis=axis)
        n = c.shape[axis]
        a = np.take(c, range(k, n), axis) - np.take(c, range(n - k), axis)
    return a


def eroded(mask: np.ndarray, k: int) -> np.ndarray:
    return window_sums(mask, k, "constant") == k * k


def dilated(mask: np.ndarray, k: int) -> np.ndarray:
    return window_sums(mask, k, "constant") > 0


def tidied(mask: np.ndarray, opening: int, closing: int) -> np.ndarray:
    """Specks narrower than the opening go, gaps narrower than the closing fill; outside the image is nothing."""
    mask = dilated(eroded(mask, opening), opening)
    return eroded(dilated(mask, closing), closing)


def smeared(grey: np.ndarray, valid: np.ndarray, window: int, opening: int, closing: int) -> np.ndarray:
    """Pixels whose surroundings' brightness runs one way: the structure tensor's coherence over COHERENT."""
    p = np.pad(grey.astype(np.int64), 1, mode="symmetric")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    a, b, c = (window_sums(x, window) for x in (dx * dx, dy * dy, dx * dy))
    root = np.sqrt(((a - b) ** 2 + 4 * c * c).astype(float))
    return tidied((root > COHERENT * (a + b)) & (a + b > 0) & valid, opening, closing)


def featureless(grey: np.ndarray, valid: np.ndarray, window: int, opening: int, closing: int) -> np.ndarray:
    """Pixels whose surroundings hardly vary: a deviation under FLAT_SD."""
    g, n = grey.astype(np.int64), window * window
    return tidied((n * window_sums(g * g, window) - window_sums(g, window) ** 2 < FLAT_SD**2 * n * n) & valid, opening, closing)


def labelled(mask: np.ndarray) -> np.ndarray:
    """Numbers of 4-connected blobs from 1, 0 outside: runs of rows that overlap are united."""
    w = mask.shape[1] + 2
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, start), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
    first = np.searchsorted(y * w + end, (y - 1) * w + start, "right")
    last = np.searchsorted(y * w + start, (y - 1) * w + end, "left")
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(y)), count)
    b = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    label = np.arange(len(y))
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not (label[label] == label).all():
            label = label[label]
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(np.unique(label, return_inverse=True)[1] + 1, end - start)
    return out


def tiled(images: DataFrame, key: str, size: int) -> DataFrame:
    """Tiles (key, ty, tx, height, width, grey, valid) of images (key, width, height, grey, mask: binaries by rows, mask of 0 and others). Sizes that do not fit give none."""

    def split(frames):
        for f in frames:
            out = []
            for k, w, h, grey, mask in zip(f[key], f["width"], f["height"], f["grey"], f["mask"]):
                g, m = (np.frombuffer(x or b"", np.uint8) for x in (grey, mask))
                if w and h and w == w and h == h and len(g) == len(m) == w * h:
                    g, m = g.reshape(int(h), int(w)), (m.reshape(int(h), int(w)) > 0).astype(np.uint8)
                    out += [(k, i, j, int(h), int(w), g[i * size : (i + 1) * size, j * size : (j + 1) * size].tobytes(), m[i * size : (i + 1) * size, j * size : (j + 1) * size].tobytes()) for i in range(-(-int(h) // size)) for j in range(-(-int(w) // size))]
            yield pd.DataFrame(out, columns=[key, *_TILE])

    return images.select(key, "width", "height", "grey", "mask").mapInPandas(split, f"`{key}` {images.schema[key].dataType.simpleString()}, {_TYPES}")


_TILE = ["ty", "tx", "height", "width", "grey", "valid"]
_TYPES = "ty int, tx int, height int, width int, grey binary, valid binary"
_FOUND = "what string, metric string, kind int, a long, b long, place string, side int, n long, nv long, rim boolean"


def shares(tiles: DataFrame, key: str, size: int, smear: tuple[int, int, int] = SMEAR, flat: tuple[int, int, int] = FLAT) -> DataFrame:
    """key, valid (pixels), smear and flat: shares of the valid pixels of each image, null where none is.

    tiles: as `tiled` makes them, of one size, keys and places unique. Blobs are kept from BLOB of the valid pixels on, holes of smeared ones
    filled first; what closing and filling spill beyond the valid part is not counted. Windows are (window, opening, closing), odd.
    """
    halo = max(1 + smear[0] // 2 + smear[1] // 2 * 2 + smear[2] // 2 * 2, flat[0] // 2 + flat[1] // 2 * 2 + flat[2] // 2 * 2)
    if halo > size:
        raise ValueError(f"tiles must be {halo} pixels wide at least")
    kind = tiles.schema[key].dataType.simpleString()

    def deal(frames):
        for f in frames:
            out = []
            for k, ty, tx, h, w, grey, valid in zip(f[key], *(f[c] for c in _TILE)):
                y, x = ty * size, tx * size
                shape = min(size, h - y), min(size, w - x)
                g, v = (np.frombuffer(b, np.uint8).reshape(shape) for b in (grey, valid))
                for i in (ty - 1, ty, ty + 1):
                    for j in (tx - 1, tx, tx + 1):
                        if 0 <= i * size < h and 0 <= j * size < w:
                            r = slice(max(i * size - halo - y, 0), max(min((i + 1) * size + halo - y, shape[0]), 0))
                            c = slice(max(j * size - halo - x, 0), max(min((j + 1) * size + halo - x, shape[1]), 0))
                            if g[r, c].size:
                                out.append((k, i, j, h, w, g[r, c].tobytes(), v[r, c].tobytes(), y + r.start, x + c.start, *g[r, c].shape))
            yield pd.DataFrame(out, columns=[key, *_TILE, "y", "x", "rows", "cols"])

    def measure(f: pd.DataFrame) -> pd.DataFrame:
        k, ty, tx, h, w = f.iloc[0][[key, "ty", "tx", "height", "width"]]
        y0, x0 = max(ty * size - halo, 0), max(tx * size - halo, 0)
        grey = np.zeros((min((ty + 1) * size + halo, h) - y0, min((tx + 1) * size + halo, w) - x0), np.uint8)
        valid = np.zeros(grey.shape, bool)
        for y, x, n, m, g, v in zip(f["y"], f["x"], f["rows"], f["cols"], f["grey"], f["valid"]):
            at = slice(y - y0, y - y0 + n), slice(x - x0, x - x0 + m)
            grey[at], valid[at] = np.frombuffer(g, np.uint8).reshape(n, m), np.frombuffer(v, np.uint8).reshape(n, m) > 0
        own = slice(ty * size - y0, min((ty + 1) * size, h) - y0), slice(tx * size - x0, min((tx + 1) * size, w) - x0)
        v = valid[own]
        out = [("tile", "", 0, 0, 0, "", 0, v.size, int(v.sum()), False)]
        base = (ty * (-(-w // size)) + tx) * 2 * (size * size + 1)
        for metric, mask in (("smear", smeared(grey, valid, *smear)[own]), ("flat", featureless(grey, valid, *flat)[own])):
            label = labelled(mask) + base
            label[~mask] = 0
            if metric == "smear":  # the rest too: parts of it that do not reach the image's edge are holes
                rest = labelled(~mask)
                label[~mask] = rest[~mask] + base + size * size + 1
            rim = np.zeros(mask.shape, bool)
            for on, edge in ((ty == 0, np.s_[0]), (ty == (h - 1) // size, np.s_[-1]), (tx == 0, np.s_[:, 0]), (tx == (w - 1) // size, np.s_[:, -1])):
                if on:
                    rim[edge] = True
            ids, back = np.unique(label, return_inverse=True)
            n, nv, on = np.bincount(back.ravel()), np.bincount(back.ravel(), v.ravel()), np.bincount(back.ravel(), rim.ravel())
            outside = lambda i: int(i - base > size * size)  # noqa: B023, E731 - used at once
            out += [("node", metric, outside(i), int(i), 0, "", 0, int(p), int(q), bool(r)) for i, p, q, r in zip(ids, n, nv, on) if i]
            if metric == "smear":
                near = [np.stack([label[:, :-1].ravel(), label[:, 1:].ravel()], 1), np.stack([label[:-1].ravel(), label[1:].ravel()], 1)]
                pairs = np.unique(np.sort(np.concatenate(near), 1), axis=0)  # blobs have smaller numbers than the rest
                out += [("touch", metric, 0, int(a), int(b), "", 0, 0, 0, False) for a, b in pairs if a != b]
            for name, side, line in ((f"h{ty}/{tx}", 1, label[0]), (f"h{ty + 1}/{tx}", 0, label[-1]), (f"v{ty}/{tx}", 1, label[:, 0]), (f"v{ty}/{tx + 1}", 0, label[:, -1])):
                out += [("side", metric, outside(i), int(i), 0, f"{name}/{p}", side, 0, 0, False) for p, i in enumerate(line.tolist()) if i]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])
        frame.insert(0, key, k)
        return frame

    wide = tiles.select(key, *_TILE).mapInPandas(deal, f"`{key}` {kind}, {_TYPES}, y int, x int, rows int, cols int")
    found = cut(wide.groupBy(key, "ty", "tx").applyInPandas(measure, f"`{key}` {kind}, {_FOUND}").withColumnRenamed(key, "image"))
    name = lambda c: F.struct("image", "metric", F.col(c).alias("id"))
    side = lambda s, p: found.filter((F.col("what") == "side") & (F.col("side") == s)).select("image", "metric", "place", name("a").alias(p), F.col("kind").alias(f"{p}_kind"))
    met = cut(side(0, "p").join(side(1, "q"), ["image", "metric", "place"]).select("p", "q", "p_kind", "q_kind").distinct())
    whole = connected_components(met.filter("p_kind = q_kind").select(F.col("p").alias("a"), F.col("q").alias("b")))
    nodes = found.filter("what = 'node'").select(name("a").alias("node"), "kind", "n", "nv", "rim").join(whole, "node", "left").withColumn("part", F.coalesce("component", "node"))
    nodes = cut(nodes.select("node", "kind", "n", "nv", "rim", "part"))
    parts = nodes.groupBy("part", "kind").agg(F.sum("n").alias("n"), F.sum("nv").alias("nv"), F.max("rim").alias("rim")).filter("kind = 0 or not rim")
    touch = found.filter("what = 'touch'").select(name("a").alias("p"), name("b").alias("q")).union(met.filter("p_kind < q_kind").select("p", "q")).union(met.filter("p_kind > q_kind").select("q", "p"))
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    holes = parts.filter("kind = 1").select(F.col("part").alias("q_part"))
    inner = touch.join(of("p"), "p").join(of("q"), "q").select(F.col("p_part").alias("a"), "q_part").distinct().join(holes, "q_part").select("a", F.col("q_part").alias("b"))
    joined = connected_components(inner)
    blobs = parts.join(joined, F.col("part") == F.col("node"), "left").groupBy(F.coalesce("component", "part").alias("blob")).agg(F.sum("n").alias("n"), F.sum("nv").alias("nv"))
    valid = found.filter("what = 'tile'").groupBy("image").agg(F.sum("nv").alias("valid"))
    kept = blobs.select("blob.image", "blob.metric", "n", "nv").join(valid, "image").filter(F.col("n") > BLOB * F.greatest("valid", F.lit(1)))
    sums = kept.groupBy("image").agg(*[F.sum(F.when(F.col("metric") == m, F.col("nv"))).alias(m) for m in ("smear", "flat")])
    part = lambda c: F.when(F.col("valid") > 0, F.coalesce(c, F.lit(0)) / F.col("valid")).alias(c)
    return valid.join(sums, "image", "left").select(F.col("image").alias(key), "valid", part("smear"), part("flat"))
