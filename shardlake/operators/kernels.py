"""Sequential numeric steps of one mesh or one image, in numpy, run group by group: plane search, hulls, pixel windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seed, samples, and the bounds of plane search and of texture masks.
SEED, SAMPLES, PLANES, PLANE_MM, TRIES, STOP = 20260820, 50_000, 8, 3.0, 1000, 0.02
COHERENT, FLAT_SD, BLOB = 0.65, 3.0, 0.02


def sample_surface(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """n points spread evenly over triangles (by area), the same for one seed; none without area."""
    size = np.linalg.norm(np.cross(b - a, c - a), axis=1) / 2
    if not size.sum():
        return np.zeros((0, 3))
    r = np.random.default_rng(seed)
    t = r.choice(len(size), n, p=size / size.sum())
    u, v = r.random(n), r.random(n)
    over = u + v > 1
    u[over], v[over] = 1 - u[over], 1 - v[over]
    return a[t] + u[:, None] * (b - a)[t] + v[:, None] * (c - a)[t]


def hull_area(points: np.ndarray) -> float | None:
    """Area of the convex hull of points in the plane, by the monotone chain; null for fewer than three places or a line."""
    p = np.unique(np.round(points, 9), axis=0)
    if len(p) < 3:
        return None

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(half(p) + half(p[::-1]))
    area = abs(float(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1)))) / 2
    return area if area > 0 else None


def find_planes(points: np.ndarray, seed: int = SEED, tries: int = TRIES) -> list[dict]:
    """Planes by repeated random search: each takes the inliers of the best of `tries` planes through three points, fitted anew.

    Ends after PLANES planes, or when the best has under STOP of all points. Sorted by falling hull area (null as 0).
    """
    r = np.random.default_rng(seed)
    rest, out = points, []
    while len(rest) >= 3 and len(out) < PLANES:
        best = None
        for _ in range(tries):
            p = rest[r.choice(len(rest), 3, replace=False)]
            n = np.cross(p[1] - p[0], p[2] - p[0])
            size = np.linalg.norm(n)
            if size > 1e-12:
                near = np.abs((rest - p[0]) @ (n / size)) <= PLANE_MM
                if best is None or near.sum() > best.sum():
                    best = near
        if best is None or best.sum() < max(3, STOP * len(points)):
            break
        q = rest[best]
        middle = q.mean(0)
        _, _, axes = np.linalg.svd(q - middle, full_matrices=False)
        d = (q - middle) @ axes[2]
        flat = hull_area((q - middle) @ axes[:2].T)
        out.append({"normal": axes[2].tolist(), "d": float(-middle @ axes[2]), "inliers": int(best.sum()), "fraction": float(best.sum() / len(points)), "area_m2": None if flat is None else flat * 1e-6, "rms_mm": float(np.sqrt((d * d).mean()))})
        rest = rest[~best]
    return sorted(out, key=lambda x: -(x["area_m2"] or 0.0))


def planes(points: DataFrame, key: str, tries: int = TRIES) -> DataFrame:
    """key, plane (from 0, largest first) and its fields, of clouds (key, id, x, y, z) in mm; bounded samples: SAMPLES points of each, by hash of id.

    A search is sequential, so a cloud is one group, of SAMPLES rows at most; clouds run side by side.
    """
    n = points.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    some = points.join(n, F.col(key) == F.col("_k")).filter(share * F.col("_n") < SAMPLES).select(key, "id", "x", "y", "z")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("id")
        got = find_planes(f[["x", "y", "z"]].to_numpy(float), tries=tries)
        return pd.DataFrame([{key: frame[key].iloc[0], "plane": k, **x} for k, x in enumerate(got)], columns=[key, "plane", "normal", "d", "inliers", "fraction", "area_m2", "rms_mm"])

    kind = points.schema[key].dataType.simpleString()
    return some.groupBy(key).applyInPandas(search, f"`{key}` {kind}, plane int, normal array<double>, d double, inliers long, fraction double, area_m2 double, rms_mm double")


def _windows(a: np.ndarray, k: int, best) -> np.ndarray:
    """The best value in a square window of odd width k around each pixel, one axis after the other; edges repeat."""
    h = k // 2
    for axis in (0, 1):
        p = np.pad(a, [(h, h) if x == axis else (0, 0) for x in (0, 1)], mode="edge")
        a = best(np.lib.stride_tricks.sliding_window_view(p, k, axis=axis), axis=-1)
    return a


def odd(mm: float, density: float) -> int:
    """A length in mm as an odd number of pixels, three at least."""
    return max(3, int(round(mm * density)) | 1)


def opened(mask: np.ndarray, k: int) -> np.ndarray:
    """Specks narrower than k go."""
    return _windows(_windows(mask, k, np.min), k, np.max)


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    """Gaps narrower than k fill."""
    return _windows(_windows(mask, k, np.max), k, np.min)


def _mean(a: np.ndarray, k: int) -> np.ndarray:
    return _windows(a, k, np.mean)


def blobs(mask: np.ndarray) -> np.ndarray:
    """Numbers of 4-connected blobs from 1, 0 outside: labels spread along runs until none changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label
        for axis in (0, 1):
            for step in (1, -1):
                near = np.roll(new, step, axis)
                edge = [slice(None), slice(None)]
                edge[axis] = slice(0, 1) if step == 1 else slice(-1, None)
                near[tuple(edge)] = 0
                new = np.where(mask & (near > 0), np.minimum(new, near), new)
        if (new == label).all():
            return label
        label = new


def largest_only(mask: np.ndarray, least: float) -> np.ndarray:
    """The blobs of at least so many pixels."""
    number, count = np.unique(blobs(mask), return_counts=True)
    return np.isin(blobs(mask), number[(count >= least) & (number > 0)])


def region_mask(width: int, height: int, uv: np.ndarray, dilate: int = 5, close: int = 9) -> np.ndarray:
    """Pixels of vertices at places uv (0 to 1, v from below), spread and closed; places outside are left out."""
    x, y = np.floor(uv[:, 0] * width).astype(int), np.floor((1 - uv[:, 1]) * height).astype(int)
    ok = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    mask = np.zeros((height, width), bool)
    mask[y[ok], x[ok]] = True
    return closed(_windows(mask, dilate, np.max), close)


def smeared(grey: np.ndarray, valid: np.ndarray, window: int = 9, tidy: int = 5) -> np.ndarray:
    """Pixels where brightness runs in one direction: coherence of the structure tensor over COHERENT, opened, closed, large blobs of the valid part."""
    p = np.pad(grey.astype(float), 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    a, b, c = _mean(dx * dx, window), _mean(dy * dy, window), _mean(dx * dy, window)
    total = a + b
    coherence = np.where(total > 1e-9, np.sqrt((a - b) ** 2 + 4 * c * c) / np.maximum(total, 1e-9), 0.0)
    return largest_only(closed(opened((coherence > COHERENT) & valid, tidy), tidy) & valid, BLOB * valid.sum())


def featureless(grey: np.ndarray, valid: np.ndarray, window: int = 9, tidy: int = 5) -> np.ndarray:
    """Pixels whose surroundings hardly vary (deviation under FLAT_SD), opened, closed, large blobs of the valid part."""
    g = grey.astype(float)
    sd = np.sqrt(np.maximum(_mean(g * g, window) - _mean(g, window) ** 2, 0))
    return largest_only(closed(opened((sd < FLAT_SD) & valid, tidy), tidy) & valid, BLOB * valid.sum())


def texture_metrics(images: DataFrame, key: str) -> DataFrame:
    """key, valid, smear and flat (shares of the valid pixels) of images (key, width, height, grey as binary rows, mask as binary of 0 and 1).

    Images are decoded one by one where they lie, so memory is that of one; a size that does not fit its pixels gives nulls.
    """

    def run(frames):
        for f in frames:
            out = []
            for k, w, h, grey, mask in zip(f[key], f["width"], f["height"], f["grey"], f["mask"]):
                g, m = (np.frombuffer(x or b"", np.uint8) for x in (grey, mask))
                if not w or not h or len(g) != w * h or len(m) != w * h:
                    out.append((k, None, None, None))
                    continue
                g, m = g.reshape(int(h), int(w)), m.reshape(int(h), int(w)) > 0
                n = int(m.sum())
                out.append((k, n, *(float(x(g, m).sum() / n) if n else None for x in (smeared, featureless))))
            yield pd.DataFrame(out, columns=[key, "valid", "smear", "flat"]).astype({"valid": "Int64"})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "grey", "mask").mapInPandas(run, f"`{key}` {kind}, valid long, smear double, flat double")
