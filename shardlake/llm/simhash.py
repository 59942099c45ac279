"""SimHash near-dedup by the generalised pigeonhole principle."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ascii_lower, carried, components, durable, ship

DISTANCE, SHINGLE = 4, 4
#: Fingerprints on which correlations and candidate counts are estimated: they choose the plan, never the result.
SAMPLE = 20000
#: Buckets of up to SMALL fingerprints are verified in one array; larger ones are split at most LEVELS times.
SMALL, LEVELS = 512, 3
#: Most rows (of four longs) of a broadcast list of buckets; longer lists are joined by a shuffle.
BROADCAST = 200_000
SPACES = "\t\n\v\f\r "


def words(text: str | None) -> list[str]:
    for c in SPACES[:-1]:
        text = (text or "").replace(c, " ")
    return [w for w in ascii_lower(text).split(" ") if w]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    w = words(text)
    if not w:
        return 0
    n = max(len(w) - size + 1, 1)
    h = np.fromiter((xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(n)), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 65536):
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and fp: the text's fingerprint as a signed long."""
    lean = docs.drop("text", "fp")
    at = docs.drop("fp").columns.index("text")

    def run(batches):
        for b in batches:
            f = [fingerprint(t) for t in b.column(at).to_pylist()]
            rest = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array([_signed(x) for x in f], pa.int64())], names=[*(b.schema.names[i] for i in rest), "fp"])

    ship(docs)
    return docs.drop("fp").mapInArrow(run, StructType([*lean.schema.fields]).add("fp", "long"))


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions of correlated bits with their thresholds: the thresholds plus one sum to the distance plus one.

    Bits join the partition they correlate with most. Dynamic programming splits the thresholds (-1: not probed)
    so that probes plus estimated candidates are fewest, over three to five partitions.
    """
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    c = np.zeros((64, 64))
    if len(bits) > 1:
        x = bits - bits.mean(0)
        s = x.std(0) + 1e-9
        c = np.abs(x.T @ x / len(x) / s[:, None] / s[None])
    best = None
    for m in (3, 4, 5):
        free, parts = list(range(64)), []
        for k in range(m):
            width = -(-len(free) // (m - k))
            part = [free.pop(0)]
            while len(part) < width:
                part.append(free.pop(int(np.argmax(c[np.ix_(part, free)].mean(0)))))
            parts.append(sorted(part))
        costs = []
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            v, n = np.unique(sample & mask, return_counts=True)
            lookup = lambda keys: np.where((at := np.searchsorted(v, keys)) < len(v), np.where(v[np.minimum(at, len(v) - 1)] == keys, n[np.minimum(at, len(v) - 1)], 0), 0)
            scale = (total / max(len(sample), 1)) ** 2
            near0 = float((n * (n - 1)).sum()) * scale
            near1 = near0 + sum(float((n * lookup(v ^ np.uint64(1 << b))).sum()) for b in part) * scale
            w = len(part)
            near2 = near1 + (near1 - near0 + scale) * w / 2
            costs.append([0.0, near0 + 20 * total, near1 + 20 * total * (1 + w), near2 + 20 * total * (1 + w + w * (w - 1) / 2)])
        goal = distance + 1
        table = {0: (0.0, [])}
        for cost in costs:
            step: dict = {}
            for used, (sofar, chosen) in table.items():
                for t1, extra in enumerate(cost):  # t1: threshold plus one
                    u = used + t1
                    if u <= goal and (u not in step or sofar + extra < step[u][0]):
                        step[u] = (sofar + extra, [*chosen, t1 - 1])
            table = step
        if goal in table and (best is None or table[goal][0] < best[0]):
            best = (table[goal][0], [(p, t) for p, t in zip(parts, table[goal][1]) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _narrower(mask: int, pieces: int) -> list[int]:
    """The mask with each of `pieces` equal shares of its free bits added in turn; free bits alternate between the shares."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i::pieces]) for i in range(min(pieces, len(free)))]


def link(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, c): distinct fingerprints and the smallest one (as signed long) they are linked with, directly or not.

    A bucket holds the fingerprints that probe one value of one partition. Every member near one of its bucket's three pivots is
    linked to it, and buckets whose members then lie in one component are done. Of the others, those of up to SMALL members are
    verified inside their array, which only the linked pairs of components leave. Larger ones are split anew by the same principle,
    over distance + 1 shares of their free bits. What is still large after LEVELS splits is linked by midpoints: two members are
    near if and only if some value lies between them, half the distance from each, and a member has as many such values
    however large its bucket is. So no step makes the pairs of a large bucket.
    """
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    parts = plan(sample, max(fps.count(), 1), distance)
    ham = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    probes, masks = [], [sum(1 << b for b in p) for p, _ in parts]
    for mask, (p, threshold) in zip(masks, parts):
        for w in range(threshold + 1):
            probes += [F.struct(F.lit(_signed(mask)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(sum(1 << b for b in c)))).alias("key"), F.lit(w).alias("w")) for c in combinations(p, w)]
    rows = fps.select("fp", F.explode(F.array(*probes)).alias("s")).select("fp", "s.mask", "s.key", "s.w")
    bucket = lambda m, k: (F.col("mask") == F.col(m)) & (F.col("key") == F.col(k))
    parts = fps.select(F.col("fp").alias("v"), F.col("fp").alias("c")).limit(0)
    grow = lambda edges: components(parts.select(F.col("c").alias("a"), F.col("v").alias("b")).union(edges))
    labelled = lambda df: df.join(parts, F.col("fp") == F.col("v"), "left").select(*df.columns, F.coalesce("c", "fp").alias("c"))
    for level in range(LEVELS + 1):
        # A pair needs one member that is probed as it is (w = 0); a fingerprint is in a bucket once.
        size = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min(F.struct(F.xxhash64("fp"), F.col("fp").alias("x")))["x"].alias("mid"), F.min("w").alias("own"))
        size = durable(size.filter("n > 1 and own = 0").select(F.col("mask").alias("m"), F.col("key").alias("k"), "n", F.array_distinct(F.array("lo", "hi", "mid")).alias("pivots")))
        lo, hi = F.col("pivots")[0], F.col("pivots")[1]
        two = size.filter((F.col("n") == 2) & (ham(lo, hi) <= distance)).select(lo.alias("a"), hi.alias("b"))
        many = size.filter("n > 2")
        many = F.broadcast(many) if many.count() <= BROADCAST else many
        rows = durable(rows.join(many, bucket("m", "k")).select("fp", "mask", "key", "w", "n", "pivots"))
        star = rows.select("fp", F.explode("pivots").alias("x")).filter((F.col("fp") != F.col("x")) & (ham(F.col("fp"), F.col("x")) <= distance)).select(F.col("x").alias("a"), F.col("fp").alias("b"))
        parts = grow(two.union(star))
        rows = durable(labelled(rows.select("fp", "mask", "key", "w", "n")))
        lists = rows.filter(F.col("n") <= SMALL).groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "c")).alias("all")).filter(F.size(F.array_distinct("all.c")) > 1)
        links = lambda x: F.filter("all", lambda y: (y["c"] < x["c"]) & (ham(x["fp"], y["fp"]) <= distance))
        pairs = F.flatten(F.transform("all", lambda x: F.transform(links(x), lambda y: F.struct(y["c"].alias("a"), x["c"].alias("b")))))
        few = durable(lists.select(F.explode(F.array_distinct(pairs)).alias("e")).select("e.a", "e.b"))
        parts = grow(few) if not few.isEmpty() else parts
        rows = rows.filter(F.col("n") > SMALL)
        if rows.isEmpty():
            break
        rows = labelled(rows.drop("c"))
        open_ = rows.groupBy(F.col("mask").alias("m"), F.col("key").alias("k")).agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2")
        rows = durable(rows.join(open_, bucket("m", "k"), "left_semi").select("fp", "mask", "key", "w"))
        if level == LEVELS:
            parts = grow(_midpoints(rows, masks, distance)) if not rows.isEmpty() else parts
            break
        pieces = {m: _narrower(m, distance + 1) for m in masks}
        masks = sorted({x for p in pieces.values() for x in p})
        table = fps.sparkSession.createDataFrame([(_signed(m), _signed(x), _signed(x & ~m)) for m, p in pieces.items() for x in p], "m long, narrow long, bits long")
        # One row a mask of the plan: at most 5 * (distance + 1) ** LEVELS.
        rows = rows.join(F.broadcast(table), F.col("mask") == F.col("m")).select("fp", F.col("narrow").alias("mask"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("bits"))).alias("key"), "w").distinct()
    return labelled(fps)


def _midpoints(rows: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links of the members (fp, mask, key, w) of buckets, each bucket's members with the smallest that is as near to a value between them."""
    near, far = distance // 2, distance - distance // 2
    out = None
    for w in range(far + 1):  # a member that was probed w bits away has spent them
        steps = {m: [(_signed(sum(1 << b for b in c)), n <= near - w) for n in range(far - w + 1) for c in combinations([b for b in range(64) if not m >> b & 1], n)] for m in masks}
        table = rows.sparkSession.createDataFrame([(_signed(m), [{"x": x, "close": y} for x, y in s]) for m, s in steps.items()], "m long, steps array<struct<x:long,close:boolean>>")
        mine = rows.filter(F.col("w") == w).join(F.broadcast(table), F.col("mask") == F.col("m"))
        mine = mine.select("fp", "mask", "key", F.explode("steps").alias("s")).select("fp", "mask", "key", F.col("fp").bitwiseAND(F.bitwise_not("mask")).bitwiseXOR(F.col("s.x")).alias("z"), "s.close")
        out = mine if out is None else out.union(mine)
    out = durable(out)
    hub = out.filter("close").groupBy(F.col("mask").alias("m"), F.col("key").alias("k"), F.col("z").alias("y")).agg(F.min("fp").alias("hub"))
    got = out.join(durable(hub), (F.col("mask") == F.col("m")) & (F.col("key") == F.col("k")) & (F.col("z") == F.col("y")))
    return got.filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))


def _grouped(f: DataFrame, distance: int) -> DataFrame:
    """Rows that have a fingerprint fp, with `group`: the smallest one of its component."""
    groups = durable(link(durable(f.select("fp").distinct()), distance)).select(F.col("fp").alias("_f"), F.col("c").alias("group"))
    return f.join(groups, F.col("fp") == F.col("_f")).drop("_f")


def near_dedup(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id, group (the component's smallest fingerprint) of every document; columns of docs but these are left out.

    Texts that are null, empty or without words have fingerprint zero. Repeated rows repeat in the result.
    A null doc_id takes part, but never names a component unless the whole component has none (then null).
    """
    f = durable(_grouped(durable(fingerprints(docs.select("doc_id", "text"))), distance))
    names = durable(f.groupBy(F.col("group").alias("_g")).agg(F.min("doc_id").alias("component_id")))
    return f.join(names, F.col("group") == F.col("_g")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group")


@carried("doc_id", "text")
def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: of the smallest doc_id (null last); of several rows, the one with the smallest hash of text, then of all columns.

    Fingerprints and choices are made on ids and hashes; texts are shuffled once, to meet the chosen keys. Rows that are
    equal in all columns count as one.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*whole, F.xxhash64("text").alias("_key"), F.xxhash64(*whole).alias("_row"))
    f = durable(_grouped(durable(fingerprints(keyed.select("doc_id", "text", "_key", "_row"))), distance))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "_key", "_row")).alias("x")
    kept = durable(f.groupBy("group").agg(first).select(F.col("x.doc_id").alias("_d"), F.col("x._key").alias("_k"), F.col("x._row").alias("_r")))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")) & (F.col("_row") == F.col("_r"))
    twice = durable(f.join(kept, same, "left_semi").groupBy("doc_id", "_key", "_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("_row").alias("_r")))
    once = keyed.join(kept.exceptAll(twice), same, "left_semi") if not twice.isEmpty() else keyed.join(kept, same, "left_semi")
    if not twice.isEmpty():
        once = once.union(keyed.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_key", "_row"]))
    return once.select(*whole)


def op8(documents: DataFrame) -> DataFrame:
    return near_dedup(documents).select("doc_id", "fingerprint", "component_id")
