"""Surfaces as tables: sampling by area, triangles to rows of pixels, loops of open edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardlake.operators.geometry import edges
from shardlake.operators.graph import cut, drop, wide

#: Areas count in whole parts of this size (of the unit's square), so that sums do not depend on their order.
GRAIN = 1e-6


def running(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Add `before`, the sum of a whole-numbered weight over the rows of smaller keys, and `total` of all; the first key names the group.

    Rows are dealt out by range of all keys; each task sums its own, and the tasks' sums, a row a task and group, are added up. A
    large group spreads over tasks. Rows with equal keys are taken in an order of their hash: equal rows alike.
    """
    group = keys[0]
    held = cut(rows.repartitionByRange(*keys, F.xxhash64(*rows.columns)).withColumn("_part", F.spark_partition_id()))
    part = held.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.sum(weight).alias("_s"))
    w = Window.partitionBy("_g")
    base = part.select("_g", "_p", (F.sum("_s").over(w.orderBy("_p")) - F.col("_s")).alias("_base"), F.sum("_s").over(w).alias("total"))
    inner = F.sum(weight).over(Window.partitionBy(group, "_part").orderBy(*keys[1:], F.xxhash64(*rows.columns)).rowsBetween(Window.unboundedPreceding, -1))
    both = held.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return both.select(*rows.columns, (F.col("_base") + F.col("_inner")).alias("before"), "total")


def sample(tri: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(key, face, at, x, y, z): n points spread over each mesh by area, number `at` from 0.

    tri: key, face, a, b, c (arrays of three). Point k stands (2k + 1) / 2n of the way through the mesh's area, triangles in the order of
    `face`: each gets its share of points to within one. Where it lies in the triangle comes from a hash of mesh, number and seed: the same
    for any partitioning. Meshes without area give no point. A triangle with a null corner has no area.
    """
    u, v = F.col("b"), F.col("c")
    side = lambda p: [p[k] - F.col("a")[k] for k in range(3)]
    (ux, uy, uz), (vx, vy, vz) = side(u), side(v)
    area = F.sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2
    t = tri.select(key, "face", "a", "b", "c", F.coalesce(F.round(area / GRAIN).cast("long"), F.lit(0)).alias("_area")).filter("_area > 0")
    t = running(t, [key, "face"], "_area")
    # point k lies in [before, before + area) of the total when (2k + 1) * total falls in [2n before, 2n (before + area)); whole numbers throughout
    first = lambda c: F.expr(f"greatest((cast({c} as decimal(38,0)) * {2 * n} + total - 1) div (cast(total as decimal(38,0)) * 2), 0L)")
    t = t.withColumn("_after", F.col("before") + F.col("_area"))
    start, end = first("before"), F.least(first("_after"), F.lit(n).cast("long"))
    points = t.withColumn("_s", start).withColumn("_e", end).filter("_s < _e").select(key, "face", "a", "b", "c", F.explode(F.sequence("_s", F.col("_e") - 1)).alias("at"))
    chance = lambda k: (F.pmod(F.xxhash64(F.col(key), F.col("at"), F.lit(seed), F.lit(k)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    points = points.withColumn("_r", F.sqrt(chance(1))).withColumn("_t", chance(2))
    place = [(1 - F.col("_r")) * F.col("a")[k] + F.col("_r") * (1 - F.col("_t")) * F.col("b")[k] + F.col("_r") * F.col("_t") * F.col("c")[k] for k in range(3)]
    return points.select(key, "face", "at", *[p.alias(c) for p, c in zip(place, "xyz")])


def pixel(u: Column, v: Column, width: int, height: int) -> tuple[Column, Column]:
    """Whole pixel corners of texture coordinates, held to 0 and 1; v counts from the lower edge, rows from the upper one."""
    held = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.floor(held(u) * width).cast("int"), F.floor((1 - held(v)) * height).cast("int")


def spans(tri: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, y, x0, x1): the rows of pixels that triangles with pixel corners x1, y1, x2, y2, x3, y3 cover, both ends included, within the image.

    A row runs from the leftmost to the rightmost crossing of its number with the triangle's sides, whose corners count; halves go inwards:
    the left end is rounded half up, the right one half down. Only rows of the image are made: a triangle costs its height.
    """
    y = [F.col(f"y{k}") for k in (1, 2, 3)]
    rows = F.sequence(F.greatest(F.least(*y), F.lit(0)), F.least(F.greatest(*y), F.lit(height - 1)))
    lines = tri.filter((F.greatest(*y) >= 0) & (F.least(*y) < height)).select(*keys, *[f"{c}{k}" for k in (1, 2, 3) for c in "xy"], F.explode(rows).alias("y"))

    def crossing(p: int, q: int) -> list[Column]:
        """Where a side meets the row: at its one place, or at both ends of a level side."""
        px, py, qx, qy = (F.col(f"{c}{k}") for k in (p, q) for c in "xy")
        on = F.col("y").between(F.least(py, qy), F.greatest(py, qy))
        at = px + (F.col("y") - py) * F.try_divide((qx - px).cast("double"), (qy - py).cast("double"))
        return [F.when(on, F.coalesce(at, px.cast("double"))), F.when(on, F.coalesce(at, qx.cast("double")))]

    ends = [c for p, q in ((1, 2), (2, 3), (3, 1)) for c in crossing(p, q)]
    cut_ = lines.select(*keys, "y", F.floor(F.least(*ends) + 0.5).cast("int").alias("x0"), F.ceil(F.greatest(*ends) - 0.5).cast("int").alias("x1"))
    return cut_.select(*keys, "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.lit(width - 1)).alias("x1")).filter("x0 <= x1")


_CORNERS = [f"{c}{k}" for k in (1, 2, 3) for c in "xy"]


def _merged(batch: pa.RecordBatch, code: np.ndarray, width: int, height: int) -> tuple[np.ndarray, ...]:
    """Rows of pixels of a batch of triangles, as `spans` makes them, with those of one code that overlap or touch as one: (a triangle of the code, y, x0, x1)."""
    x, y = (np.stack([np.asarray(batch.column(f"{c}{k}")) for k in (1, 2, 3)]).astype(float) for c in "xy")
    low, high = np.maximum(y.min(0), 0).astype(np.int64), np.minimum(y.max(0), height - 1).astype(np.int64)
    n = np.maximum(high - low + 1, 0)
    t = np.repeat(np.arange(len(n)), n)
    at = low[t] + np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
    left, right = np.full(len(t), np.inf), np.full(len(t), -np.inf)
    for p, q in ((0, 1), (1, 2), (2, 0)):
        px, py, qx, qy = x[p][t], y[p][t], x[q][t], y[q][t]
        on, level = (at >= np.minimum(py, qy)) & (at <= np.maximum(py, qy)), py == qy
        cross = px + (at - py) * ((qx - px) / np.where(level, 1.0, qy - py))
        for end, own in ((left, np.minimum), (right, np.maximum)):
            end[on] = own(end, np.where(level, own(px, qx), cross))[on]
    x0, x1 = np.maximum(np.floor(left + 0.5), 0).astype(np.int64), np.minimum(np.ceil(right - 0.5), width - 1).astype(np.int64)
    some = np.flatnonzero(x0 <= x1)
    line = code[t[some]] * height + at[some]
    order = np.lexsort((x0[some], line))
    some, line = some[order], line[order]
    start, end = line * (width + 2) + x0[some], line * (width + 2) + x1[some]
    new = np.flatnonzero(np.concatenate([[True], start[1:] > np.maximum.accumulate(end)[:-1] + 1])) if len(some) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(end, new) - line[new] * (width + 2) if len(some) else new
    return t[some[new]], at[some[new]], x0[some[new]], top


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0).dictionary_encode("encode").indices).astype(np.int64)


def _flat(batch: pa.RecordBatch, tri: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> pa.RecordBatch:
    """Rows of pixels as triangles without height, which cover the same."""
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(tri)), *(pa.array(v.astype(np.int32)) for v in (x0, y, x1, y, x1, y))], ["key", *_CORNERS])


def _thinned(width: int, height: int):
    """Triangles of batches; where an image has more of them in a batch than its rows of pixels, those rows instead. So an image of many triangles is not all sent to one task."""

    def thin(batches):
        for batch in batches:
            code = _codes(batch)
            many = np.bincount(code)[code] > 2 * height
            if many.any():
                some = batch.filter(pa.array(many))
                rows = _flat(some, *_merged(some, code[many], width, height))
                if len(rows) < len(some):
                    yield rows
                    batch = batch.filter(pa.array(~many))
            yield pa.RecordBatch.from_arrays(batch.columns, ["key", *_CORNERS])

    return thin


def _covered(width: int, height: int):
    """Rows of pixels of triangles sorted by key. The last key of a batch goes on in the next one as its rows so far, so that a task holds a batch and one image's rows."""

    def cover(batches):
        held = None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, ["key", *_CORNERS])
            if held is not None:
                both = [pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns)]
                batch = pa.RecordBatch.from_arrays(both, ["key", *_CORNERS])
            if not len(batch):
                continue
            code = _codes(batch)
            tri, *row = _merged(batch, code, width, height)
            last = code[tri] == code[-1]
            held = _flat(batch, tri[last], *(v[last] for v in row))
            yield _rows(batch, tri[~last], *(v[~last] for v in row))
        if held is not None:
            yield pa.RecordBatch.from_arrays([held.column(k) for k in (0, 2, 1, 3)], ["key", "y", "x0", "x1"])

    return cover


def _rows(batch: pa.RecordBatch, tri: np.ndarray, *row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(tri)), *(pa.array(v.astype(np.int32)) for v in row)], ["key", "y", "x0", "x1"])


def union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1): the same pixels in spans that neither overlap nor touch. One image row of a key is sorted together, equal spans once."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    top = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.select(*keys, "y", "x0", "x1").distinct().withColumn("_new", F.when(F.col("x0") > top + 1, 1).when(top.isNull(), 1).otherwise(0))
    part = new.withColumn("_part", F.sum("_new").over(w))
    return part.groupBy(*keys, "y", "_part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_part")


def texture_mask(tri: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, y, x0, x1): the pixels of an image that its triangles cover, in spans that neither overlap nor touch; tri has key and texture coordinates u1, v1, u2, v2, u3, v3.

    Nulls are no triangle. Only triangles' pixel corners are dealt out, once, by image; many triangles of an image are merged to rows of pixels before.
    """
    corners = [c.alias(f"{n}{k}") for k in (1, 2, 3) for c, n in zip(pixel(F.col(f"u{k}"), F.col(f"v{k}"), width, height), "xy")]
    given = tri.dropna(subset=[f"{c}{k}" for k in (1, 2, 3) for c in "uv"])
    kind = given.schema[key].dataType.simpleString()
    slim = given.select(F.col(key).alias("key"), *corners).mapInArrow(_thinned(width, height), f"key {kind}, {', '.join(f'{c} int' for c in _CORNERS)}")
    rows = slim.repartition("key").sortWithinPartitions("key").mapInArrow(_covered(width, height), f"key {kind}, y int, x0 int, x1 int")
    return rows.withColumnRenamed("key", key)


def pixels(rows: DataFrame) -> DataFrame:
    """One row a pixel (x) of spans."""
    return rows.select(*[c for c in rows.columns if c not in ("x0", "x1")], F.explode(F.sequence("x0", "x1")).alias("x"))


def uv_area(tri: DataFrame, key: str) -> DataFrame:
    """key and uv_area, the share of the image that its triangles' texture coordinates span; overlaps count each time."""
    u, v = [F.col(f"u{k}") for k in (1, 2, 3)], [F.col(f"v{k}") for k in (1, 2, 3)]
    one = F.abs((u[1] - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (v[1] - v[0])) / 2
    return tri.groupBy(key).agg(F.coalesce(F.sum(one), F.lit(0.0)).alias("uv_area"))


def boundary_loops(tri: DataFrame, key: str) -> DataFrame:
    """(key, loop, place, vertex): the open edges of meshes (i, j, k of each triangle) as loops, in the triangles' direction; place counts from 0.

    An edge is open where the triangles beside it do not run it as often in one direction as in the other: it is left over that many times. Every vertex is entered as
    often as it is left; the n-th edge in, by the vertex it comes from, goes on with the n-th edge out. So all edges lie on loops. A loop is named by the
    number of its smallest edge (by vertices) and begins there. Its edges are ranked by pointer jumping: rounds grow with the logarithm of the longest loop.
    """
    e = edges(tri, key).filter("balance <> 0")
    way = e.select(key, F.when(F.col("balance") > 0, F.col("u")).otherwise(F.col("v")).alias("p"), F.when(F.col("balance") > 0, F.col("v")).otherwise(F.col("u")).alias("q"), F.explode(F.sequence(F.lit(1), F.abs("balance").cast("int"))).alias("copy"))
    out = way.withColumn("n", F.row_number().over(Window.partitionBy(key, "p").orderBy("q", "copy")))
    into = way.withColumn("n", F.row_number().over(Window.partitionBy(key, "q").orderBy("p", "copy")))
    name = F.struct("p", "q", "copy")
    step = into.select(key, F.col("q").alias("at"), "n", name.alias("edge")).join(wide(out.select(key, F.col("p").alias("at"), "n", name.alias("next"))), [key, "at", "n"])
    # the smallest edge of each loop: what 2^k steps reach, and the smallest on the way
    state = cut(step.select(key, "edge", "next", F.least("edge", "next").alias("least")))
    while True:
        far = state.select(key, F.col("edge").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        new = cut(state.join(wide(far), [key, "next"]).select(key, "edge", F.col("_next").alias("next"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("changed")))
        done = new.filter("changed").isEmpty()
        drop(state)
        state = new
        if done:
            break
    first = state.select(key, "edge", F.col("least").alias("loop"))
    # the way to the loop's end, counted in doubling steps; the last edge stands before the smallest one
    chain = step.join(wide(first), [key, "edge"]).select(key, "loop", "edge", F.when(F.col("next") != F.col("loop"), F.col("next")).alias("next"))
    chain = cut(chain.withColumn("left", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long")))
    while not chain.filter("next is not null").isEmpty():
        far = chain.select(key, F.col("edge").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        moved = chain.filter("next is not null").join(wide(far), [key, "next"]).select(key, "loop", "edge", F.col("_next").alias("next"), (F.col("left") + F.col("_left")).alias("left"))
        new = cut(moved.unionByName(chain.filter("next is null")))
        drop(chain)
        chain = new
    size = chain.groupBy(key, "loop").agg(F.count(F.lit(1)).alias("_n"))
    names = size.withColumn("_loop", F.row_number().over(Window.partitionBy(key).orderBy("loop")) - 1)
    return chain.join(wide(names), [key, "loop"]).select(key, F.col("_loop").cast("long").alias("loop"), (F.col("_n") - 1 - F.col("left")).alias("place"), F.col("edge.p").alias("vertex"))


def _overlaps(side: Column) -> Column:
    return (F.abs(F.col("x") - F.col("_x")) < side) & (F.abs(F.col("y") - F.col("_y")) < side)


def _dealt(tiles: DataFrame, side: Column) -> DataFrame:
    """Tiles (image, x, y and others) once for each of the nine cells around their own, as _x and _y."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    cells = {f"c{n}": F.floor(F.col(n) / side) + F.col(f"s.{k}") for n, k in (("x", "a"), ("y", "b"))}
    return tiles.select("*", near.alias("s")).withColumns(cells).drop("s").withColumnsRenamed({"x": "_x", "y": "_y"})


def spaced(tiles: DataFrame, key: str, order: list[str], side: int | str) -> DataFrame:
    """Tiles (key, image, x, y) that one after another, in the order given, lie less than a side from none taken before in their image, both ways.

    The same as the loop, in rounds: cells of the side's width hold one taken tile at most, so the first open tile of a cell is all that may be taken there. It is, once no
    open tile before it overlaps it, and what it overlaps goes. Open tiles meet the first ones of the nine cells around them, never each other. The side is a number or a
    column that is the same all over an image. Keys are unique; a round takes at least the first open tile of each image. Null images, places or orders take no part.
    """
    wide_ = F.col("_side")
    t = tiles.dropna(subset=[key, "image", "x", "y", *order]).select(F.col(key).alias("_key"), "image", "x", "y", F.struct(*order, key).alias("rank"), (F.col(side) if isinstance(side, str) else F.lit(side)).alias("_side"))
    open_, taken, cell = cut(t.withColumns({f"c{n}": F.floor(F.col(n) / wide_) for n in "xy"})), [], ["image", "cx", "cy"]
    while not open_.isEmpty():
        heads = cut(open_.groupBy(*cell).agg(F.min(F.struct("rank", "_key", "x", "y", "_side")).alias("h")).select("image", "h.*"))
        dealt = _dealt(heads.select("image", "x", "y", "_side", F.col("rank").alias("_rank"), F.col("_key").alias("_head")), wide_).drop("_side")
        late = open_.join(wide(dealt), cell).filter(_overlaps(wide_) & (F.col("rank") < F.col("_rank"))).select("_head").distinct()
        free = cut(heads.join(wide(late), F.col("_key") == F.col("_head"), "left_anti"))
        near = _dealt(free.select("image", "x", "y", "_side"), wide_).drop("_side")
        rest = cut(open_.alias("t").join(wide(near.alias("u")), (F.col("t.image") == F.col("u.image")) & (F.col("t.cx") == F.col("u.cx")) & (F.col("t.cy") == F.col("u.cy")) & _overlaps(wide_), "left_anti"))
        drop(open_, heads)
        taken.append(free.select("_key"))
        open_ = rest
    drop(open_)
    out = taken[0] if taken else t.select("_key").limit(0)
    for f in taken[1:]:
        out = out.unionByName(f)
    return tiles.join(wide(out), F.col(key) == F.col("_key"), "left_semi")


def candidates(images: DataFrame, tries: int, mm: float, least: int, most: int, lit: int = 18, seed: int = 0) -> DataFrame:
    """(image, at, x, y, side, share) of `tries` squares an image, numbered from 0: where they lie comes from digests, share is the part of their pixels brighter than `lit`.

    images: image, width, height, density (pixels a mm; null counts as 1.5), bright (brightest channel by rows, binary). A side is mm times the
    density, held to least and most. Images no larger than a side, or whose pixels do not fit their size, give none. A task holds one image.
    """
    kind = images.schema["image"].dataType.simpleString()
    side = F.floor(F.least(F.greatest(F.coalesce("density", F.lit(1.5)) * mm, F.lit(least)), F.lit(most))).cast("int")
    ready = images.withColumn("side", side).filter((F.col("width") > F.col("side")) & (F.col("height") > F.col("side")) & (F.octet_length("bright") == F.col("width").cast("long") * F.col("height")))
    draw = lambda axis, at: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("image").cast("string"), at.cast("string"), F.lit(f"{seed}{axis}")).cast("binary")), 1, 8), 16, 10).cast("long")
    place = lambda at: F.struct(at.alias("at"), (draw("x", at) % (F.col("width") - F.col("side"))).cast("int").alias("x"), (draw("y", at) % (F.col("height") - F.col("side"))).cast("int").alias("y"))
    ready = ready.withColumn("places", F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), place))

    def measure(frames):
        for f in frames:
            out = []
            for image, w, h, n, bright, places in zip(f["image"], f["width"], f["height"], f["side"], f["bright"], f["places"]):
                on = (np.frombuffer(bright, np.uint8).reshape(int(h), int(w)) > lit).astype(np.int64)
                sums = np.pad(on.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
                x, y = np.array([p["x"] for p in places]), np.array([p["y"] for p in places])
                share = (sums[y + n, x + n] - sums[y, x + n] - sums[y + n, x] + sums[y, x]) / (n * n)
                out.append(pd.DataFrame({"image": image, "at": [p["at"] for p in places], "x": x, "y": y, "side": n, "share": share}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["image", "at", "x", "y", "side", "share"])

    return ready.select("image", "width", "height", "side", "bright", "places").mapInPandas(measure, f"image {kind}, at int, x int, y int, side int, share double")


def label_tiles(found: DataFrame, n: int, used: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """Of candidates the n first of each image that are lit enough, share no pixel with a used one (image, x, y) and lie half a side from those before."""
    t = found.filter(F.col("share") >= least)
    if used is not None:
        wide = found.select("image", "side").distinct()
        old = _dealt(used.select("image", "x", "y").join(wide, "image"), F.col("side")).drop("side")
        cell = {f"c{c}": F.floor(F.col(c) / F.col("side")) for c in "xy"}
        here = t.withColumns(cell).alias("t")
        same = [F.col(f"t.{c}") == F.col(f"u.{c}") for c in ("image", "cx", "cy")]
        t = here.join(old.alias("u"), same[0] & same[1] & same[2] & _overlaps(F.col("side")), "left_anti").drop("cx", "cy")
    t = t.withColumns({"half": F.floor(F.col("side") / 2), "tile": F.struct("image", "at")})
    kept = spaced(t, "tile", ["at"], "half")
    first = F.row_number().over(Window.partitionBy("image").orderBy("at"))
    return kept.withColumn("_n", first).filter(F.col("_n") <= n).drop("_n", "half", "tile")
