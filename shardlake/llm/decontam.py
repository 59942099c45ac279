"""Benchmark decontamination: a BM25 index of test items with block maxima, queried by every training passage."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import carried, durable, kept, ship

#: Words of the items of one index (about 100 bytes each in memory), items of a block, and the retrieval threshold as a share of an
#: item's own score. INDEX and BLOCK bound memory and work, never the result.
INDEX, BLOCK, RETRIEVE = 1 << 20, 2, 0.5
#: A hit shares this much of an item's shingles of five words.
SHINGLE, SIMILARITY = 5, 0.8
K1, B = 1.2, 0.75
#: Starts of passages that one query of the index covers.
STRIDE = 256
EPS = 1e-9
WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(w: list[str]) -> set[tuple]:
    return {tuple(w[i : i + SHINGLE]) for i in range(max(len(w) - SHINGLE + 1, 1))} if w else set()


class Item:
    """A test item: its words, its normalised BM25 weights (they sum to 1) and the shingles of the whole, the question and the answer."""

    def __init__(self, ident, text: str, df: dict[str, int], n: int, mean: float):
        w = tokens(text)
        self.ident, self.size, self.whole = ident, len(w), shingles(w)
        tail = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if tokens(s)]
        k = len(tokens(tail[-1])) if len(tail) > 1 else 0
        self.question, self.answer = shingles(w[: len(w) - k]), shingles(w[len(w) - k :]) if k else set()
        self.lengths = {len(next(iter(s))) for s in (self.whole, self.question, self.answer) if s}
        raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
        total = sum(raw[t] for t in sorted(raw))
        self.weights = {t: x / total for t, x in raw.items()}

    def share(self, passage: list[str]) -> float | None:
        """Share of the item's shingles in a passage that is retrieved for it and is a hit, else None."""
        if sum(self.weights[t] for t in sorted(self.weights.keys() & set(passage))) < RETRIEVE - EPS:
            return None
        have = {tuple(passage[i : i + n]) for n in self.lengths for i in range(len(passage) - n + 1)}
        share = len(self.whole & have) / len(self.whole)
        both = self.question and self.answer and all(len(s & have) >= SIMILARITY * len(s) for s in (self.question, self.answer))
        return share if share >= SIMILARITY or both else None


class Index:
    """Inverted index of items of like length: postings by term, with the maxima of each term and of its blocks of items."""

    def __init__(self, items: list[Item], vocab: dict[str, int]):
        self.items, self.longest, self.width = items, max(i.size for i in items), BLOCK
        self.stride = max(STRIDE, self.longest)
        post: dict[int, list] = {}
        for j, item in enumerate(items):
            for t, x in item.weights.items():
                post.setdefault(vocab[t], []).append((j, x))
        self.ids = {c: [j for j, _ in p] for c, p in post.items()}
        self.weights = {c: [x for _, x in p] for c, p in post.items()}
        self.top = {c: max(w) for c, w in self.weights.items()}
        self.blocks = -(-len(items) // self.width)
        maxima = {c: {} for c in post}
        for c, p in post.items():
            for j, x in p:
                maxima[c][j // self.width] = max(maxima[c].get(j // self.width, 0.0), x)
        order = sorted(post)
        self.at = np.zeros(max(order) + 2, dtype=np.int64)  # of each term: where its blocks begin
        for c in order:
            self.at[c + 1] = len(maxima[c])
        self.at = np.cumsum(self.at)
        self.block = np.array([k for c in order for k in maxima[c]], dtype=np.int64)
        self.most = np.array([x for c in order for x in maxima[c].values()])

    def retrieve(self, codes: np.ndarray) -> list[int]:
        """All items of which the query's distinct terms score RETRIEVE or more: block-max WAND over cursors in item order."""
        codes = codes[codes < len(self.at) - 1]
        first, n = self.at[codes], self.at[codes + 1] - self.at[codes]
        codes, first, n = codes[n > 0], first[n > 0], n[n > 0]
        if not len(codes):
            return []
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        bound = np.bincount(self.block[at], self.most[at], self.blocks)
        hot = bound >= RETRIEVE - EPS
        if not hot.any():
            return []
        live = np.flatnonzero(hot).tolist()
        codes = codes[np.bincount(np.repeat(np.arange(len(n)), n), hot[self.block[at]]) > 0]  # the others have no postings in blocks that may hold a hit
        lists = [(self.ids[c], self.weights[c], self.top[c]) for c in codes.tolist()]
        pos, out = [0] * len(lists), []

        def advance(target: int, which) -> None:
            for k in which:
                pos[k] = bisect_left(lists[k][0], target, pos[k])

        advance(live[0] * self.width, range(len(lists)))
        while True:
            order = sorted((lists[k][0][pos[k]], k) for k in range(len(lists)) if pos[k] < len(lists[k][0]))
            total, pivot = 0.0, None
            for doc, k in order:
                total += lists[k][2]
                if total >= RETRIEVE - EPS:
                    pivot = doc
                    break
            if pivot is None:
                return out
            if bound[pivot // self.width] < RETRIEVE - EPS:  # nothing in the pivot's block: all cursors move to the next block that may hold a hit
                k = bisect_left(live, pivot // self.width)
                if k == len(live):
                    return out
                advance(live[k] * self.width, range(len(lists)))
            elif order[0][0] == pivot:
                mine = [k for doc, k in order if doc == pivot]
                if sum(lists[k][1][pos[k]] for k in mine) >= RETRIEVE - EPS:
                    out.append(pivot)
                for k in mine:
                    pos[k] += 1
            else:
                advance(pivot, [k for doc, k in order if doc < pivot])


class Shard:
    """Indexes of items by length (up to 64 words, 256, and so on), so that long items do not widen the queries for short ones."""

    def __init__(self, items: list[tuple], df: dict[str, int], n: int, mean: float):
        made = [Item(i, t, df, n, mean) for i, t in items]
        self.vocab = {t: k for k, t in enumerate(sorted({t for i in made for t in i.weights}))}
        tiers: dict[int, list] = {}
        for i in made:
            tiers.setdefault(max(3, math.ceil(math.log(i.size, 4))), []).append(i)
        self.tiers = [Index(tiers[k], self.vocab) for k in sorted(tiers)]

    def hits(self, text: str | None) -> dict:
        """Items of which some passage is a hit, with the largest share.

        An item's passages are twice its own words long and begin at each multiple of its words, so a copy lies whole in one. The
        index is queried with stretches that hold all passages which begin in them: what it misses no passage can reach.
        """
        w = tokens(text)
        get = self.vocab.get
        code = np.array([get(t, -1) for t in w], dtype=np.int64)
        found: dict = {}
        for index in self.tiers if (code >= 0).any() else ():
            for a in range(0, len(w), index.stride):
                part = code[a : a + index.stride + 2 * index.longest]
                for j in index.retrieve(np.unique(part[part >= 0])):
                    item = index.items[j]
                    for b in range(-(-a // item.size) * item.size, min(a + index.stride, max(len(w) - item.size, 1)), item.size):
                        share = item.share(w[b : b + 2 * item.size])
                        if share is not None:
                            found[item.ident] = max(found.get(item.ident, 0.0), share)
        return found


@carried("doc_id", "text")
def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Add n_items, items (ids, ascending, comma-joined, null last as `null`) and overlap (the largest share) to every document.

    Null and empty texts have no hit; an item whose text is null or has no word is none; of items with equal or null ids each is
    looked up, and the id counts once. Document frequencies and the mean length are those of all items; items are dealt
    to shards of about INDEX words, each one pass over the documents in a job of its own, so a task holds one shard. The result depends on neither.
    Rows are independent; columns of these names are replaced.
    """
    ship(docs)
    lean = docs
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").filter("text is not null")

    def cut(batches):
        for b in batches:
            d = b.to_pydict()
            w = [tokens(t) for t in d["text"]]
            keep = [k for k, x in enumerate(w) if x]
            yield pa.RecordBatch.from_arrays([pa.array([d["id"][k] for k in keep], pa.int64()), pa.array([d["text"][k] for k in keep], pa.string()), pa.array([len(w[k]) for k in keep], pa.int64()), pa.array([sorted(set(w[k])) for k in keep], pa.list_(pa.string()))], names=["id", "text", "n", "terms"])

    items = durable(items.mapInArrow(cut, "id long, text string, n long, terms array<string>"))
    total, n = items.agg(F.sum("n"), F.count(F.lit(1))).first()
    shards = (total or 0) // INDEX + 1
    one = lean.select(*lean.columns, F.lit(None).cast(_HITS).alias("_hits"))
    if n:
        mine = items.withColumn("s", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
        df = durable(items.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")))

        def shard(s: int):
            own = mine.filter(F.col("s") == s)
            known = own.select(F.explode("terms").alias("t")).distinct().join(df, "t").collect()
            rows = sorted(map(tuple, own.select("id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            return docs.sparkSession.sparkContext.broadcast(Shard(rows, dict(map(tuple, known)), n, total / n))

        if shards == 1:
            one = lean.mapInArrow(_probe(shard(0)), StructType([*lean.schema.fields, StructField("_hits", _HITS)]))
        else:
            # one shard a stage: its hits are written, by digest of the text, before the next shard is made
            parts = []
            for s in range(shards):
                index = shard(s)
                parts.append(kept(lean.filter("text is not null").select("text").mapInArrow(_probe(index), StructType([StructField("text", StringType()), StructField("_hits", _HITS)])).filter("size(_hits) > 0").select(F.unhex(F.md5("text")).alias("_of"), F.explode("_hits").alias("x"))))
                index.unpersist()
            best = reduce(DataFrame.unionByName, parts).groupBy("_of", F.col("x.id").alias("id")).agg(F.max("x.share").alias("share"))
            best = best.groupBy("_of").agg(F.collect_list(F.struct("id", "share")).alias("_hits"))
            one = lean.join(best, F.unhex(F.md5("text")) == F.col("_of"), "left").select(*lean.columns, "_hits")
    out = one.withColumn("_hits", F.coalesce("_hits", F.array().cast(_HITS)))
    h = F.array_sort(F.transform("_hits", lambda x: F.struct(x["id"].isNull().alias("nil"), x["id"].alias("id"), x["share"].alias("share"))))
    return out.select(*lean.columns, F.size("_hits").cast("long").alias("n_items"), F.array_join(F.transform(h, lambda x: F.coalesce(x["id"].cast("string"), F.lit("null"))), ",").alias("items"), F.coalesce(F.array_max(F.transform("_hits", lambda x: x["share"])), F.lit(0.0)).alias("overlap"))


_HITS = ArrayType(StructType([StructField("id", LongType()), StructField("share", DoubleType())]))


def _probe(shard):
    def run(batches):
        kind = pa.list_(pa.struct([("id", pa.int64()), ("share", pa.float64())]))
        for b in batches:
            hits = [[{"id": i, "share": x} for i, x in shard.value.hits(t).items()] for t in b.column(b.schema.names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, kind)], names=[*b.schema.names, "_hits"])

    return run


def op10(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(documents.select("doc_id", "text"), benchmark).select("doc_id", F.expr("n_items > 0").alias("contaminated"), "n_items", "items", "overlap")
