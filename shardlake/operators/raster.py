"""Pixels and grid cells as tables: coherence, entropy, boxes, cells of regions, painted labels and checks of exemplars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardlake.operators.graph import connected_components, cut, wide

#: Wide enough for pixel numbers: a pixel (x, y) has the number y * WIDE + x.
WIDE = 1 << 31


def number(x: Column, y: Column) -> Column:
    return y.cast("long") * WIDE + x.cast("long")


def coherence(pixels: DataFrame, key: str) -> DataFrame:
    """key, pixels, coherence: the share of a mask's pixels (key, x, y) in its largest blob of 4-neighbours.

    Masks lie on one grid and may overlap; a pixel named twice counts once. Pixels beside each other in a row are one run; blobs are components of runs over the
    pixels of the next row that stand below them. Pixels without a mask are a blob each.
    """
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    before = F.lag("x").over(row)
    p = pixels.select(key, "x", "y").distinct().withColumn("_new", F.when(F.coalesce(before != F.col("x") - 1, F.lit(True)) | F.col(key).isNull(), F.col("x")))
    p = p.withColumn("_x0", F.max("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    up = F.when((F.lag("y").over(column) == F.col("y") - 1) & F.col(key).isNotNull(), F.lag("_x0").over(column))
    at = lambda x, y: F.struct(F.col(key).alias(key), number(F.col(x), y).alias("n"))
    runs = p.withColumn("_up", up).select(at("_x0", F.col("y")).alias("a"), F.when(F.col("_up").isNotNull(), at("_up", F.col("y") - 1)).alias("b"))
    runs = cut(runs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    blobs = connected_components(runs.select("a", F.coalesce("b", "a").alias("b")))
    size = runs.groupBy("a").agg(F.when(F.col("a.n").isNull(), 1).otherwise(F.sum("n")).alias("n"))
    blobs = blobs.join(wide(size), F.col("node") == F.col("a")).groupBy("component").agg(F.sum("n").alias("n"))
    return blobs.groupBy(F.col(f"component.{key}").alias(key)).agg(F.sum("n").alias("pixels"), (F.max("n") / F.sum("n")).alias("coherence"))


def colour_entropy(pixels: DataFrame, key: str, least: int = 64) -> DataFrame:
    """key, pixels, entropy in bits over 64 colour bins (the two upper bits of r, g and b), to three digits; null under `least` pixels."""
    cube = F.shiftright("r", 6) * 16 + F.shiftright("g", 6) * 4 + F.shiftright("b", 6)
    n = pixels.groupBy(key, cube.alias("cube")).agg(F.count(F.lit(1)).alias("n"))
    # With N pixels in all, the entropy is log2 N less the mean of log2 n: one aggregation over bins.
    total = F.sum("n")
    bits = F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 3)
    return n.groupBy(key).agg(total.alias("pixels"), F.when(total >= least, bits).alias("entropy"))


def empty_cells(pixels: DataFrame, keys: list[str], grey: str, dark: int = 15, share: float = 0.9) -> DataFrame:
    """keys, empty: cells of which nine tenths of the pixels are darker than `dark`."""
    return pixels.groupBy(*keys).agg((F.avg((F.col(grey) < dark).cast("double")) >= share).alias("empty"))


def area(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Shared area of two boxes (x1, y1, x2, y2) by their united area; 0 where that is 0."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def box_fault(box: Column, masked: Column, least: float = 0.5) -> Column:
    """Why a box in shares of an image is not taken: malformed, stock (all corners are multiples of a twentieth), off the mask; else null."""
    ends = [box[c] for c in ("x1", "y1", "x2", "y2")]
    inside = ends[0].between(0, 1) & ends[1].between(0, 1) & ends[2].between(0, 1) & ends[3].between(0, 1)
    shape = F.coalesce(inside & (ends[0] < ends[2]) & (ends[1] < ends[3]), F.lit(False))
    stock = F.lit(True)
    for c in ends:
        stock &= F.abs(c * 20 - F.round(c * 20)) < 1e-6
    return F.when(~shape, "malformed").when(stock, "stock").when(F.coalesce(masked < least, F.lit(True)), "off the mask")


def painted(masks: DataFrame, order: str, label: str) -> DataFrame:
    """x, y and label of every painted pixel: the last one painted wins, of equal order the larger label."""
    return masks.groupBy("x", "y").agg(F.max_by(label, F.struct(order, label)).alias(label))


def labels_in(pixels: DataFrame, label: str) -> DataFrame:
    """label, pixels and share of a painted map, largest first."""
    n = pixels.groupBy(label).agg(F.count(F.lit(1)).alias("pixels"))
    total = n.agg(F.sum("pixels")).first()[0] or 1
    return n.withColumn("share", F.col("pixels") / F.lit(total)).orderBy(F.desc("pixels"), label)


def cells(winners: DataFrame, regions: DataFrame, anomalies: DataFrame, least: float = 0.3) -> DataFrame:
    """cell, label, source: a cell has its region's label, or that of the anomaly that covers most of it (`least` or more), none if excluded.

    winners: cell, region, excluded; regions: region, label; anomalies: cell, label, cover.
    """
    over = anomalies.filter(F.col("cover") >= least).groupBy("cell").agg(F.max_by("label", F.struct("cover", "label")).alias("_a"))
    r = regions.select(F.col("region").alias("_r"), F.col("label").alias("_l"))
    both = winners.join(r, F.col("region") == F.col("_r"), "left").join(over, "cell", "left")
    on = ~F.coalesce("excluded", F.lit(False))
    return both.select("cell", F.when(on, F.coalesce("_a", "_l")).alias("label"), F.when(on & F.col("_a").isNotNull(), "anomaly").when(on & F.col("_l").isNotNull(), "region").alias("source"))


def exemplar_faults(images: DataFrame, most: int = 4) -> DataFrame:
    """label, image, fault of exemplar images (label, image, width, height, filler, detail, transparent), one row a fault.

    Faults: side outside 100 to 512, over a tenth filler, detail under 4, transparency, more than `most` of a label (by name), and labels
    with less than half of the fullest one's and two fewer (image null).
    """
    side = F.array_compact(F.array(
        F.when(~(F.col("width").between(100, 512) & F.col("height").between(100, 512)), "size"), F.when(F.col("filler") > 0.10, "filler"), F.when(F.col("detail") < 4, "detail"), F.when(F.col("transparent"), "transparent")))
    own = images.select("label", "image", F.explode(side).alias("fault"))
    n = images.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n")).first()[0] or 0
    many = n.filter(F.col("n") > most).select("label", F.lit(None).cast("string").alias("image"), F.lit("too many").alias("fault"))
    few = n.filter((F.lit(top) >= 2 * F.col("n")) & (F.lit(top) - F.col("n") >= 2)).select("label", F.lit(None).cast("string").alias("image"), F.lit("imbalance").alias("fault"))
    return own.union(many).union(few)


def overlay(base: Column, colour: Column, on: Column, weight: float = 0.72, dim: float | None = None) -> Column:
    """A channel (0 to 255) blended towards a colour where `on`; elsewhere as it is, or times `dim`."""
    mixed = F.floor(base * (1 - weight) + colour * weight)
    rest = base if dim is None else F.floor(base * dim)
    return F.when(F.coalesce(on, F.lit(False)), mixed).otherwise(rest).cast("int")


def export_by_label(crops: DataFrame, path: str) -> None:
    """Candidate crops (label, name, and what else they hold) as Parquet, one folder a label; folders of other labels stay."""
    crops.filter("label is not null").write.partitionBy("label").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
