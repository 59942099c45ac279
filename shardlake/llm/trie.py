"""The trie of conversation prefixes: a Cartesian tree over the shared lengths of sorted conversations.

Conversations are sorted over partitions, the blocks. The nodes that begin at a conversation are those deeper than what it shares with the
one before, and each ends where the shared length next falls below its depth: its nearest smaller value. Within a block a stack finds it; a
node that leaves its block ends in the first block whose minimum is below its depth. The parts of such nodes add up by key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, kept, ship

#: Bytes of a turn's digest in a sequence; rows that a node of a block holds until its smallest member is known (then they wait for a join instead).
DIGEST, WAITING = 16, 20_000

_PART = "block long, ref long, origin long, depth long, whole boolean, n long, low long, kids long, leaves long, gross long, once long, ends binary"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, block long, ref long"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, item): item holds the digest of a turn's role and text and the bytes of its text; null role or text counts as empty. Rows without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("item"))


def sequence(conv_id: Column, items: Column) -> list[Column]:
    """Columns of `trie`: conv_id, the digests behind each other, the texts' sizes."""
    return [conv_id.alias("conv_id"), F.unhex(F.array_join(F.transform(items, lambda x: F.hex(x["digest"])), "")).alias("keys"), F.transform(items, lambda x: x["bytes"]).alias("sizes")]


def sequences(conversations: DataFrame) -> DataFrame:
    """Each conversation by its turns, as it stands. Turns are ordered by number, null first, equal numbers by digest."""
    got = turns(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return got.select(*sequence(F.col("conv_id"), F.sort_array("items")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of c - c % 5 for its own first h, where h = crc32(c) % 9; in one shuffle of digests."""
    t = turns(conversations).withColumn("base", F.expr("conv_id - conv_id % 5")).repartition("base")
    all_ = t.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    heads = all_.filter("conv_id = base").select(F.col("base").alias("of"), F.slice("items", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    none = F.slice("items", 1, 0)
    rest = F.slice("items", h + 1, F.greatest(F.size("items") - h, F.lit(0)))
    items = F.concat(F.when(F.col("head").isNull(), none).otherwise(F.slice("head", F.lit(1), h)), rest)
    return all_.join(heads, F.col("base") == F.col("of"), "left").select("conv_id", items.alias("items")).select(*sequence(F.col("conv_id"), F.col("items")))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences of digests begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    if n > 64 * DIGEST:
        x, y = (np.frombuffer(s, np.uint8, n) for s in (a, b))
        return int(np.argmax(x != y)) // DIGEST
    k = 0
    while a[k : k + DIGEST] == b[k : k + DIGEST]:
        k += DIGEST
    return k // DIGEST


def _borders(batches):
    """(block, first and last sequence, least shared length inside) of a block."""
    first = last = least = None
    for batch in batches:
        for block, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if first is None:
                first, at = keys, block
            else:
                k = shared(last, keys)
                least = k if least is None or k < least else least
            last = keys
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([least], pa.int64())], ["block", "first", "last", "least"])


def _between(batches):
    """Turns that a block's first sequence shares with the last one before; -1 before all."""
    for batch in batches:
        got = [-1 if b is None else shared(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(got, pa.int64())], ["block", "least", "border"])


class Blocks:
    """What each block must know of the others: a few numbers a block, as many as Spark made partitions."""

    def __init__(self, rows: list):
        self.at = {r[0]: k for k, r in enumerate(rows)}
        self.name = [r[0] for r in rows]
        self.border = [r[2] for r in rows] + [-1]
        self.least = [r[2] if r[1] is None else min(r[1], r[2]) for r in rows]
        self.smaller = []  # the nearest block before with a smaller minimum
        for k, v in enumerate(self.least):
            j = k - 1
            while j >= 0 and self.least[j] >= v:
                j = self.smaller[j]
            self.smaller.append(j)

    def origin(self, block: int, depth: int) -> int:
        """The block in which the node of this depth that is open before a block began."""
        j = self.at[block] - 1
        while self.least[j] >= depth:
            j = self.smaller[j]
        return self.name[j]


class _Node:
    """A frame: whether the node began in this block, the bytes of its last text, and sums over what lies below it in this block."""

    __slots__ = ("opened", "size", "ref", "n", "low", "kids", "leaves", "gross", "once", "ends", "rows", "waiting")

    def __init__(self, opened: bool, size: int, ref: int | None):
        self.opened, self.size, self.ref = opened, size, ref
        self.n = self.kids = self.leaves = self.gross = self.once = self.waiting = 0
        self.low = None
        self.ends: list[str] = []
        self.rows: list[list] = []

    def sums(self) -> list:
        return [self.n, self.low, self.kids, self.leaves, self.gross, self.once]


class _Walk:
    """One pass over a block: the nodes that lie in it whole or, if `parts`, its parts of the others, and which node a reference means.

    When a node ends, its sums flow to its parent. Its row waits there for the parent's smallest member. A parent at depth d that began before the block
    is known as 2d, one that goes on behind it as 2d + 1, and where too many rows wait it gets a negative number; the rows then go with the block and that reference.
    """

    def __init__(self, blocks: Blocks, parts: bool):
        self.blocks, self.parts = blocks, parts
        self.stack: list[_Node] = []
        self.out: list[list] = []
        self.block, self.serial = None, 0

    def wait(self, up: _Node, row: list) -> None:
        """Lay a row up with its parent."""
        up.waiting += 1
        if not self.parts:
            up.rows.append(row)
        if up.ref is None and up.waiting >= WAITING:
            self.serial += 1
            up.ref = -self.serial
        if up.ref is not None:
            self.send(up, up.ref)

    def send(self, node: _Node, ref: int) -> None:
        self.out += [[*r, self.block, ref] for r in node.rows]
        node.rows = []

    def close(self, ends: bool) -> None:
        """Take the deepest node off; it ends in this block, or goes on behind it."""
        node, depth = self.stack.pop(), len(self.stack)
        node.gross += node.n * node.size
        node.once += node.size if node.opened else 0
        up = self.stack[-1] if self.stack else None
        if up:
            up.n, up.leaves, up.gross, up.once = up.n + node.n, up.leaves + node.leaves, up.gross + node.gross, up.once + node.once
            up.low = node.low if up.low is None or (node.low is not None and node.low < up.low) else up.low
        listed = ",".join(node.ends).encode()
        if node.opened and ends:
            if node.ref is None:
                self.out += [[*r[:2], node.low, *r[3:], None, None] for r in node.rows]
            elif self.parts:
                self.out.append([self.block, node.ref, self.block, depth, True, *node.sums(), None])
            row = [node.low, depth, None, node.n, node.kids, node.leaves, node.gross - node.once, "" if self.parts else hashlib.sha256(listed).hexdigest()]
            if up:
                self.wait(up, row)
            elif not self.parts:
                self.out.append([*row, None, None])
            return
        ref = 2 * depth + node.opened
        self.send(node, ref)
        if self.parts:
            origin = self.block if node.opened else self.blocks.origin(self.block, depth)
            self.out.append([self.block, ref, origin, depth, False, *node.sums(), listed or None])
            # further references to the same node: the number that rows have gone with already, and the name of what goes on behind the block
            names = ([node.ref] if node.ref is not None and node.ref < 0 else []) + ([ref + 1] if not node.opened and not ends else [])
            self.out += [[self.block, x, origin, depth, False, 0, None, 0, 0, 0, 0, None] for x in names]

    def rows(self, batches):
        """Lists of some thousand rows."""
        before, length = None, 0
        for batch in batches:
            for block, conv, keys, sizes in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if before is None:
                    self.block, common = block, self.blocks.border[self.blocks.at[block]]
                    self.stack = [_Node(False, sizes[d - 1] if d else 0, 2 * d) for d in range(common + 1)]
                else:
                    common = shared(before, keys)
                    if common < length:
                        self.stack[-1].leaves += 1
                    while len(self.stack) > common + 1:
                        self.close(True)
                for d in range(common + 1, len(sizes) + 1):
                    if self.stack:
                        self.stack[-1].kids += 1
                    self.stack.append(_Node(True, sizes[d - 1] if d else 0, None))
                top = self.stack[-1]
                top.n += 1
                top.ends.append(str(conv))
                top.low = conv if top.low is None else min(top.low, conv)
                before, length = keys, len(sizes)
                if len(self.out) > 4096:
                    yield self.out
                    self.out = []
        if before is not None:
            after = self.blocks.border[self.blocks.at[self.block] + 1]
            if after < length:
                self.stack[-1].leaves += 1
            while self.stack:
                self.close(len(self.stack) - 1 > after)
        yield self.out


def _rows(blocks: Blocks, parts: bool, names: list[str], schema: pa.Schema):
    def run(batches):
        for rows in _Walk(blocks, parts).rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], names)

    return run


def _digests(batches):
    """(origin, depth, ends_sha256) of each node, over its parts in order: one part in memory at a time."""
    key = hasher = None
    for batch in batches:
        done = []
        for origin, depth, ends in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if key != (origin, depth):
                if key:
                    done.append((*key, hasher.hexdigest()))
                key, hasher = (origin, depth), hashlib.sha256(ends)
            else:
                hasher.update(b"," + ends)
        yield _three(done)
    if key:
        yield _three([(*key, hasher.hexdigest())])


def _three(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["origin", "depth", "ends_sha256"])


def trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie of rows (conv_id, keys, sizes), as `sequence` makes them, with what lies below each.

    conv_id: the smallest member (a node's conversations begin with it); depth; parent_conv_id: the parent's (root: null); n_convs; n_children;
    n_leaves: childless nodes of the subtree; saved_tokens: (n_convs - 1) times the bytes of the last text, summed over the subtree;
    ends_sha256: digest of the ids that end here, ascending. Subtrees include their top. No rows, no nodes; turnless ones belong to the root.

    Lean rows (16 bytes a turn) are sorted by range, ids included, so that equal conversations spread. Tasks hold a stack as deep as a
    conversation, and WAITING rows a frame. The driver gets three numbers a block. A conversation is one row. The digest of all ids that end at one node is
    sequential by nature: a task streams them, a string a block.
    """
    spark = sequences.sparkSession
    ship(sequences)
    ordered = sequences.select("conv_id", "keys", "sizes").repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    ordered = durable(ordered.select(F.spark_partition_id().cast("long").alias("block"), "conv_id", "keys", "sizes"))
    borders = ordered.select("block", "keys").mapInArrow(_borders, "block long, first binary, last binary, least long")
    borders = borders.select("block", "first", F.lag("last").over(Window.orderBy("block")).alias("last"), "least")  # a row a block
    blocks = Blocks(sorted(tuple(r) for r in borders.mapInArrow(_between, "block long, least long, border long").collect()))

    def rows(parts: bool, schema: str) -> DataFrame:
        kind = spark.createDataFrame([], schema).schema
        arrow = pa.schema([(f.name, {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[s.split()[1]]) for f, s in zip(kind, schema.split(", "))])
        return ordered.mapInArrow(_rows(blocks, parts, kind.names, arrow), kind)

    parts = kept(rows(True, _PART))
    ends = parts.filter("ends is not null").select("origin", "depth", "ends", "block").repartition("origin", "depth").sortWithinPartitions("origin", "depth", "block")
    ends = ends.select("origin", "depth", "ends").mapInArrow(_digests, "origin long, depth long, ends_sha256 string")
    long_ = parts.filter("not whole").groupBy("origin", "depth").agg(F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.sum("kids").alias("n_children"), F.sum("leaves").alias("n_leaves"), (F.sum("gross") - F.sum("once")).alias("saved_tokens"))
    name = long_.select(F.col("origin").alias("o"), F.col("depth").alias("d"), F.col("conv_id").alias("parent_of"))
    path = parts.join(name, (F.col("origin") == F.col("o")) & (F.col("depth") == F.col("d")) & ~F.col("whole"), "left")
    path = kept(path.select(F.col("block").alias("at"), F.col("ref").alias("to"), F.when(F.col("whole"), F.col("low")).otherwise(F.col("parent_of")).alias("parent")))
    empty = hashlib.sha256(b"").hexdigest()
    long_ = long_.join(ends, ["origin", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    long_ = long_.join(path, (F.col("origin") == F.col("at")) & (2 * F.col("depth") - 1 == F.col("to")), "left").withColumn("parent_conv_id", F.col("parent"))
    nodes = rows(False, _NODE).withColumn("block", F.coalesce("block", -1 - F.abs(F.xxhash64("conv_id", "depth"))))  # no such block: rows that wait for nothing spread
    nodes = nodes.join(path, (F.col("block") == F.col("at")) & (F.col("ref") == F.col("to")), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    return nodes.select(_COLUMNS).unionByName(long_.select(_COLUMNS))


def op13(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see `rebuilt`)."""
    return trie(rebuilt(conversations))


SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST) AS items FROM t GROUP BY c),
h AS (SELECT c, items, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS h FROM o),
w AS (SELECT h.c, list_concat(coalesce(b.items[1:h.h], []), h.items[h.h + 1:]) AS items FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
p AS (SELECT c, d, items[1:d] AS k, len(items) = d AS last FROM w, unnest(range(0, len(items) + 1)) AS r(d)),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(strlen(k[d].t), 0) AS size,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM p GROUP BY k, d),
e AS (SELECT u.k, u.d, count(*) FILTER (v.d = u.d + 1) AS n_children, sum((v.n_convs - 1) * v.size) AS saved
    FROM n u JOIN n v ON v.d >= u.d AND v.k[1:u.d] = u.k GROUP BY u.k, u.d),
f AS (SELECT u.k, u.d, count(*) AS n_leaves FROM n u JOIN e v ON v.n_children = 0 AND v.d >= u.d AND v.k[1:u.d] = u.k GROUP BY u.k, u.d)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, e.n_children, f.n_leaves, e.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN e ON e.k = n.k AND e.d = n.d JOIN f ON f.k = n.k AND f.d = n.d LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.k[1:n.d - 1]
"""
