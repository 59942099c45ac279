"""Convex hulls and oriented boxes of point clouds: partial hulls a task, merged in a tree, so that no cloud is one task.

What lies inside the hull of a part lies inside the hull of the whole: each step keeps hull points only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that a task gathers before it reduces them to hulls, partial hulls that one task merges, and points of a cloud that are not reduced before the last step.
GATHER, FAN, LEAST = 200_000, 16, 256
#: Distance, as a share of the cloud's extent, below which a point counts as lying on a plane, line or point.
FLAT = 1e-9
_TINY = np.finfo(float).tiny


def corners(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the hull's points, its triangles as places, seen from outside counterclockwise) of n x 3 points.

    Flat clouds have no triangles: of a plane the corners of its polygon are given, of a line its ends, of one spot one point.
    """
    first = np.lexsort((points[:, 2], points[:, 1], points[:, 0]))
    p = points[first]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]).any(1)
    first, p = first[new], p[new]
    scale = float(np.ptp(p, axis=0).max(initial=0.0))
    least = FLAT * scale
    none = np.zeros((0, 3), np.int64)
    if scale == 0:
        return first[:1], none
    a = int(np.argmin(p[:, np.argmax(np.ptp(p, axis=0))]))
    b = int(np.argmax(((p - p[a]) ** 2).sum(1)))
    along = (p[b] - p[a]) / np.linalg.norm(p[b] - p[a])
    off = p - p[a] - np.outer((p - p[a]) @ along, along)
    c = int(np.argmax((off**2).sum(1)))
    if np.linalg.norm(off[c]) <= least:
        t = (p - p[a]) @ along
        return first[[int(np.argmin(t)), int(np.argmax(t))]], none
    up = np.cross(along, off[c] / np.linalg.norm(off[c]))
    height = (p - p[a]) @ up
    d = int(np.argmax(np.abs(height)))
    if abs(height[d]) <= least:
        return first[polygon(np.stack([(p - p[a]) @ along, (p - p[a]) @ (off[c] / np.linalg.norm(off[c]))], 1))], none
    faces = _quickhull(p, [a, c, b, d] if height[d] > 0 else [a, b, c, d], least)
    return first[np.unique(faces)], first[faces]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of three; much cheaper on few rows than numpy's own."""
    (ax, ay, az), (bx, by, bz) = a.T, b.T
    return np.stack([ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx], 1)


def _planes(p: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = p[faces[:, 0]]
    n = _cross(p[faces[:, 1]] - a, p[faces[:, 2]] - a)
    n /= np.maximum(np.sqrt((n * n).sum(1))[:, None], _TINY)
    return n, (n * a).sum(1)


def _quickhull(p: np.ndarray, start: list[int], least: float) -> np.ndarray:
    """Triangles of the hull: the point farthest outside a face replaces all faces that it sees by a fan over their rim."""
    a, b, c, d = start
    faces = np.array([[a, b, c], [a, c, d], [c, b, d], [b, a, d]])
    normal, level = _planes(p, faces)
    dead = np.zeros(len(faces), bool)
    side = p @ normal.T - level
    owner, far = side.argmax(1), side.max(1)
    while True:
        k = int(np.argmax(far))
        if far[k] <= least:
            return faces[~dead]
        seen = np.flatnonzero(~dead & (normal @ p[k] - level > least))
        if not len(seen):  # rounding only
            far[k] = -np.inf
            continue
        edges = faces[seen][:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
        code, back = edges[:, 0] * len(p) + edges[:, 1], edges[:, 1] * len(p) + edges[:, 0]
        rim = edges[~np.isin(code, back)]
        new = np.column_stack([rim, np.full(len(rim), k)])
        n, h = _planes(p, new)
        dead[seen] = True
        moved = np.flatnonzero(dead[owner] & (far > least))
        base = len(faces)
        faces, normal, level = np.concatenate([faces, new]), np.concatenate([normal, n]), np.concatenate([level, h])
        dead = np.concatenate([dead, np.zeros(len(new), bool)])
        side = p[moved] @ n.T - h
        far[moved], owner[moved] = side.max(1), base + side.argmax(1)
        far[k] = -np.inf
        if dead.sum() > 64 + len(dead) // 2:  # forget faces that are gone
            place = np.cumsum(~dead) - 1
            owner = np.where(dead[owner], 0, place[owner])
            faces, normal, level, dead = faces[~dead], normal[~dead], level[~dead], np.zeros(int((~dead).sum()), bool)


def polygon(xy: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex polygon around n x 2 points, counterclockwise from the leftmost; without points on its sides."""
    order = np.lexsort((xy[:, 1], xy[:, 0]))

    at = xy.tolist()

    def chain(places) -> list[int]:
        out: list[int] = []
        for k in places:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = at[out[-2]], at[out[-1]], at[k]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(k)
        return out

    low, high = chain(order.tolist()), chain(order[::-1].tolist())
    return np.array(low[:-1] + high[:-1] if len(order) > 1 else low, np.int64)


def volume(points: np.ndarray, faces: np.ndarray) -> float:
    if not len(faces):
        return 0.0
    o = points.mean(0)
    a, b, c = (points[faces[:, k]] - o for k in range(3))
    return float((a * np.cross(b, c)).sum() / 6)


def box(points: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, axes as rows) of the smallest box that stands on a face of the hull, by falling dimension; equal volumes keep the first.

    On each face's plane the sides of the projection's polygon are tried: a smallest rectangle lies on one of them. A flat cloud
    stands on its own plane, a line on itself, one spot on the axes. Axes point where their largest component is positive.
    """
    if len(faces):
        normals = _planes(points, faces)[0]
        normals *= np.where(np.take_along_axis(normals, np.abs(normals).argmax(1)[:, None], 1) < 0, -1, 1)
        seen: dict = {}
        for k, n in enumerate(np.round(normals, 9).tolist()):
            seen.setdefault(tuple(n), k)
        normals = normals[list(seen.values())]
    else:
        spread = np.linalg.svd(points - points.mean(0))[2] if len(points) > 1 else np.eye(3)
        normals = spread[-1:]
    best = None
    us = _cross(normals, np.eye(3)[np.abs(normals).argmin(1)])
    us /= np.sqrt((us * us).sum(1))[:, None]
    vs = _cross(normals, us)
    for n, u, v in zip(normals, us, vs):
        flat = np.stack([points @ u, points @ v], 1)
        ring = flat[polygon(flat)]
        way = np.concatenate([ring[1:], ring[:1]]) - ring if len(ring) > 1 else np.array([[1.0, 0.0]])
        size = np.sqrt((way * way).sum(1))
        way = way[size > 0] / size[size > 0, None]
        across = np.stack([-way[:, 1], way[:, 0]], 1)
        wide, deep = np.ptp(ring @ way.T, axis=0), np.ptp(ring @ across.T, axis=0)
        k = int(np.argmin(wide * deep))
        tall = np.ptp(points @ n)
        if best is None or tall * wide[k] * deep[k] < best[0] * (1 - 1e-12):
            to = lambda w: w[0] * u + w[1] * v  # noqa: B023, E731 - used at once
            best = tall * wide[k] * deep[k], np.array([tall, wide[k], deep[k]]), np.stack([n, to(way[k]), to(across[k])])
    _, dims, axes = best
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1) < 0, -1, 1)
    order = np.argsort(-dims, kind="stable")
    return dims[order], axes[order]


def _shrunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """What was gathered, with the clouds of more than LEAST points in it reduced to their hull points; smaller ones stay, as a hull would cost more than it saves."""
    table = pa.Table.from_batches(batches).combine_chunks()
    xyz = _xyz(table)
    fine = np.flatnonzero(np.isfinite(xyz).all(1))
    keys = table.column(0)
    code = np.asarray(pa.concat_arrays(keys.chunks).dictionary_encode("encode").indices)[fine] if len(table) else np.zeros(0, np.int64)
    n = np.bincount(code)
    large = n[code] > LEAST
    kept, many = [fine[~large]], fine[large]
    many = many[np.argsort(code[large], kind="stable")]
    for rows in np.split(many, np.cumsum(n[n > LEAST])[:-1]) if len(many) else ():
        kept.append(rows[corners(xyz[rows])[0]])
    rows = np.concatenate(kept)
    out = table if len(rows) == len(table) else table.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in out.columns], schema=batches[0].schema)


def _reduced(batches: Iterator[pa.RecordBatch]):
    """Hull points of the large clouds in what the task has gathered; what is still too much goes on to the next step."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > GATHER:
            held = [_shrunk(held)]
            if held[0].num_rows > GATHER // 2:
                yield held.pop()
    if held:
        yield _shrunk(held)


def merged(points: DataFrame, key: str) -> DataFrame:
    """(key, x, y, z): few points of each cloud, its hull's among them, so that one task can take a cloud.

    Tasks reduce what they read to partial hulls; these are merged FAN at a time, by cloud and number of the part.
    """
    kind = points.schema[key].dataType.simpleString()
    df = points.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    parts = max(points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shape = f"key {kind}, x double, y double, z double"
    df = df.mapInArrow(_reduced, shape)
    if parts > FAN:
        df = df.withColumn("salt", F.spark_partition_id().cast("long"))
    while parts > FAN:
        parts = -(-parts // FAN)
        df = df.withColumn("salt", F.pmod(F.col("salt"), F.lit(parts)).cast("long"))
        df = df.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_reduced, f"{shape}, salt long")
    return df.select("key", "x", "y", "z")


def hull_points(points: DataFrame, key: str) -> DataFrame:
    """(key, x, y, z): the hull's points of each cloud, from points x, y, z; see `merged`.

    Rows with a null or infinite coordinate take no part; null keys are one cloud. Repeated points and points on a face, an edge or a side of the hull go.
    """
    df = merged(points, key)
    return df.groupBy("key").applyInArrow(_one, df.schema).withColumnRenamed("key", key)


def _xyz(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(k).to_numpy() for k in "xyz"]).astype(float, copy=False)


def _one(table: pa.Table) -> pa.Table:
    return table.take(pa.array(corners(_xyz(table))[0])).select(["key", "x", "y", "z"])


def bounding_boxes(points: DataFrame, key: str) -> DataFrame:
    """key, hull_points, hull_volume, obb_dims_mm and obb_axes_xyz (both by falling dimension) of each cloud. Flat clouds have volume 0."""
    kind = points.schema[key].dataType.simpleString()

    def measure(table: pa.Table) -> pa.Table:
        xyz = _xyz(table)
        at, faces = corners(xyz)
        place = np.zeros(len(xyz), np.int64)
        place[at] = np.arange(len(at))
        xyz, faces = xyz[at], place[faces]
        dims, axes = box(xyz, faces)
        out = {"key": table.column("key")[:1], "hull_points": pa.array([len(at)], pa.int64()), "hull_volume": pa.array([volume(xyz, faces)])}
        out |= {"obb_dims_mm": pa.array([dims.tolist()], pa.list_(pa.float64())), "obb_axes_xyz": pa.array([axes.tolist()], pa.list_(pa.list_(pa.float64())))}
        return pa.table(out)

    out = merged(points, key).groupBy("key").applyInArrow(measure, f"key {kind}, hull_points long, hull_volume double, obb_dims_mm array<double>, obb_axes_xyz array<array<double>>")
    return out.withColumnRenamed("key", key)
