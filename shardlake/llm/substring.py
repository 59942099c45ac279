"""Substring dedup: runs of consecutive sentences that occur again are removed."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import carried, durable, ship

#: A run ends with its third sentence or later, once it has 15 words, or with any sentence that brings it to 40.
SENTENCES, WORDS, LONG = 3, 15, 40
#: A run is hot if it has more than one HOT-th of all places of repeated runs: fewer than HOT runs can be, however large the input.
HOT = 1000
PIECE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")


def sentences(text: str) -> list[str]:
    """Pieces that join to the text; a piece without words belongs to the one before it."""
    out: list[str] = []
    for p in PIECE.findall(text):
        if out and not any(map(str.isalnum, p)):
            out[-1] += p
        else:
            out.append(p)
    return out


def spans(text: str) -> list[tuple[int, int, int, int]]:
    """(first sentence, sentence behind the last, two hashes that are halves of one of 128 bits) of the shortest run that begins and that ends at each sentence, if any.

    They cover all sentences of every longer run, so a whole passage goes if it is a run.
    """
    words = [p.lower().split() for p in sentences(text)]
    size = [0]
    for w in words:
        size.append(size[-1] + len(w))
    ends = lambda i, j: size[j] - size[i] >= LONG or (j - i >= SENTENCES and size[j] - size[i] >= WORDS)
    runs = set()
    i, j = 0, 1
    while j <= len(words):  # the first end of a run from i; both only move on
        if i < j and ends(i, j):
            runs.add((i, j))
            i += 1
        else:
            j += 1
    i = 0
    for j in range(1, len(words) + 1):
        if ends(i, j):
            while ends(i + 1, j):
                i += 1
            runs.add((i, j))
    out = []
    for i, j in sorted(runs):
        h = xxhash.xxh3_128_intdigest(" ".join(w for s in words[i:j] for w in s))
        out.append((i, j, *(x - (1 << 64) if x >> 63 else x for x in divmod(h, 1 << 64))))
    return out


@carried("doc_id", "text")
def dedup(docs: DataFrame) -> DataFrame:
    """The documents with repeated runs taken out of text, plus n_sentences and n_removed.

    A run is several consecutive sentences: SENTENCES or more with WORDS words or more together, or any number with LONG words or more,
    a single one included (long sentences are repeated passages too). Shorter repeats stay. Every run consists of the shortest runs
    that begin and that end at its sentences, so only those are hashed, to 128 bits: among 10**12 runs two different ones share a
    hash with a probability under 10**-14.

    First is the smallest (doc_id, text hash, sentence), null ids last; every other place of a run that occurs more than once loses all
    its sentences. Spaces inside a run and case do not matter. Null texts stay null, empty ones empty; equal rows
    count as one document. Runs are pre-aggregated by hash before the shuffle; the join back is by hash, but for hot
    runs, which are broadcast (fewer than HOT rows) so that their places stay where they are. Columns named
    n_sentences or n_removed are replaced.
    """
    ship(docs)
    docs = docs.drop("n_sentences", "n_removed")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))

    def emit(batches):
        for b in batches:
            d = b.to_pydict()
            at, first, end, halves, hashes = [], [], [], [], []
            for k, t in enumerate(d["text"]):
                for i, j, g, h in spans(t):
                    at.append(k)
                    first.append(i)
                    end.append(j)
                    halves.append(g)
                    hashes.append(h)
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(halves, pa.int64()), pa.array(hashes, pa.int64())], names=["d", "k", "i", "j", "g", "h"])

    lean = docs.filter("text is not null").select(F.col("doc_id").alias("d"), key.alias("k"), "text")
    schema = StructType([*lean.schema.fields[:2]]).add("i", "integer").add("j", "integer").add("g", "long").add("h", "long")
    runs = lean.mapInArrow(emit, schema)  # made twice: to keep them would take more disk than the texts
    place = F.struct(F.col("d").isNull().alias("nil"), "d", "k", "i")
    firsts = durable(runs.groupBy(F.col("h").alias("fh"), F.col("g").alias("fg")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    share = F.col("n") * HOT > (firsts.agg(F.sum("n")).first()[0] or 0)
    two = lambda df, p: df.select(F.col("fh").alias(f"{p}h"), F.col("fg").alias(f"{p}g"), F.col("first").alias(f"{p}_first"))
    hot, rest = F.broadcast(two(firsts.filter(share), "b")), two(firsts.filter(~share), "c")
    again = runs.join(hot, (F.col("h") == F.col("bh")) & (F.col("g") == F.col("bg")), "left")
    # Places of hot runs have met their first one: they are dealt by place, not by run, and meet none in the second join.
    deal = F.when(F.col("b_first").isNull(), F.col("h")).otherwise(F.xxhash64("d", "k", "i"))
    again = again.select("d", "k", "i", "j", "g", deal.alias("_h"), F.coalesce(place != F.col("b_first"), F.lit(False)).alias("_hit"))
    again = again.join(rest, (F.col("_h") == F.col("ch")) & (F.col("g") == F.col("cg")), "left").filter(F.col("_hit") | (place != F.col("c_first")))
    cover = again.groupBy(F.col("d").alias("_d"), F.col("k").alias("_k")).agg(F.collect_set(F.struct("i", "j")).alias("_cover"))
    whole = docs.withColumn("_key", key).join(cover, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").drop("_key", "_d", "_k")

    def cut(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts, count, gone = [], [], []
            for t, c in zip(b.column(at).to_pylist(), b.column(b.schema.get_field_index("_cover")).to_pylist()):
                s = sentences(t or "")
                dead = {x for r in c or () for x in range(r["i"], r["j"])}
                texts.append("".join(p for i, p in enumerate(s) if i not in dead) if dead else t)
                count.append(len(s))
                gone.append(len(dead))
            cols = {n: c for n, c in zip(b.schema.names, b.columns) if n != "_cover"}
            cols["text"] = pa.array(texts, b.schema.field(at).type)
            cols |= {"n_sentences": pa.array(count, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return whole.mapInArrow(cut, StructType([*docs.schema.fields]).add("n_sentences", "long").add("n_removed", "long"))


def op7(documents: DataFrame) -> DataFrame:
    return dedup(documents.select("doc_id", "text"))
