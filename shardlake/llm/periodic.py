"""Periodic runs of words by a harmonic grid: longest common extensions at jp and (j+1)p, from suffix arrays and range minima."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .bpe import ragged, slices
from .common import SPACE_WORD, ship

#: Shortest run in words, and the least number of its periods.
SHORTEST, TIMES = 6, 4
#: Bytes of text searched together, grid places compared together, and words of a block of range minima.
SLICE, GRID, BLOCK = 4 << 20, 1 << 21, 32

RUNS = ArrayType(StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")]), False)


class Extensions:
    """Longest common extensions to the right of two places in one document, over all documents of a slice at once.

    Suffixes are sorted within their document (words are told apart by document in the first ranks), by doubling; only suffixes
    that are not yet alone take part in a further round. Extensions are range minima of the lengths shared by neighbours.
    """

    def __init__(self, words: np.ndarray, end: np.ndarray):
        """words: codes of all words; end: behind each word, where its document ends. Memory: 4 bytes a word a round, with log2(longest repeat) rounds."""
        n = len(words)
        key = end * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[order] = first
        levels, step = [rank], 1
        open_ = order[~(new & np.append(new[1:], True))]
        while len(open_):
            beyond = open_ + step
            second = np.where(beyond < end[open_], rank[np.minimum(beyond, n - 1)], -1).astype(np.int64)
            key = rank[open_].astype(np.int64) * (n + 1) + second + 1
            by = np.argsort(key, kind="stable")
            open_, key, old = open_[by], key[by], rank[open_[by]]
            place = np.arange(len(open_))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, place, 0))
            rank = rank.copy()
            rank[open_] = old + first - group
            order[old + place - group] = open_
            levels.append(rank)
            open_ = open_[~(new & np.append(new[1:], True))]
            step *= 2
        self.rank, self.minima = rank, Minima(shared(order, levels, end))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j, two places of one document, have in common."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.minima(np.minimum(a, b) + 1, np.maximum(a, b))


def shared(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order (0 at the first of a document): equal ranks of 2^k words, longest first."""
    out = np.zeros(len(order), np.int32)
    at = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    i, j = order[at - 1], order[at]
    length = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = i + length, j + length
        inside = np.flatnonzero((x < end[i]) & (y < end[j]))
        same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        length[same] += 1 << k
    out[at] = length
    return out


class Minima:
    """Range minima in linear memory: a sparse table over blocks, running minima from both ends of a block, a look at each place within one."""

    def __init__(self, values: np.ndarray):
        n = -(-max(len(values), 1) // BLOCK)
        grid = np.full(n * BLOCK, np.iinfo(np.int32).max, np.int32)
        grid[: len(values)] = values
        self.values, grid = grid, grid.reshape(n, BLOCK)
        self.left = np.minimum.accumulate(grid, 1).ravel()
        self.right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [grid.min(1)]
        while (half := 1 << (len(self.table) - 1)) * 2 <= n:
            self.table.append(np.minimum(self.table[-1][: n - 2 * half + 1], self.table[-1][half : n - half + 1]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value of places a to b, both included, a <= b."""
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.right[a], self.left[b])
        far = np.flatnonzero(y - x > 1)
        width = y[far] - x[far] - 1
        level = np.frexp(width.astype(np.float64))[1] - 1
        for k in np.unique(level):
            some = far[level == k]
            out[some] = np.minimum(out[some], np.minimum(self.table[k][x[some] + 1], self.table[k][y[some] - (1 << int(k))]))
        near = np.flatnonzero(x == y)
        if len(near):
            best = self.values[a[near]]
            for k in range(1, BLOCK):
                best = np.minimum(best, self.values[np.minimum(a[near] + k, b[near])])
            out[near] = best
        return out


def grid(starts: np.ndarray, sizes: np.ndarray):
    """(i, p) in batches: places i = start + jp of each document, for each period p of which a run can hold four, while i + p lies in it."""
    sizes = np.where(sizes >= SHORTEST, sizes, 0)
    top = sizes // TIMES
    period = ragged(np.ones(len(top), np.int64), top)
    start, size = np.repeat(starts, top), np.repeat(sizes, top)
    places = (size - 1) // np.maximum(period, 1)
    bounds = np.cumsum(places)
    k = 0
    while k < len(period):
        done = int(bounds[k - 1]) if k else 0
        j = max(k + 1, int(np.searchsorted(bounds, done + GRID, "right")))
        if places[k] > GRID:  # one period of a very long document: its places in parts
            for a in range(0, int(places[k]), GRID):
                at = np.arange(a, min(a + GRID, int(places[k])))
                yield start[k] + at * period[k], np.full(len(at), period[k])
        else:
            p = np.repeat(period[k:j], places[k:j])
            yield np.repeat(start[k:j], places[k:j]) + ragged(np.zeros(j - k, np.int64), places[k:j]) * p, p
        k = j


def find(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs (document, start, length, period) of documents whose words lie behind each other, by document, start and period.

    A run of four periods p holds three grid pairs (jp, (j+1)p) at least; extended both ways, any of them gives it whole. Pairs that
    differ in their first word extend over no word to the right and are passed over. A stretch whose period is a multiple of a
    smaller one is found with both and keeps the smaller: two periods of one stretch of four have their divisor as period too.
    """
    starts, sizes = bounds[:-1], np.diff(bounds)
    n = len(words)
    begin, end = np.repeat(starts, sizes), np.repeat(bounds[1:], sizes)
    hits, right, left = [], None, None
    for x, q in grid(starts, sizes):
        same = np.flatnonzero(words[x] == words[x + q])
        if not len(same):
            continue
        if right is None:
            right, left = Extensions(words, end), Extensions(words[::-1].copy(), (n - begin)[::-1].copy())
        x, q = x[same], q[same]
        ahead = right(x, x + q)
        inner = np.flatnonzero(x > begin[x])
        back = np.zeros(len(x), np.int64)
        back[inner] = left(n - x[inner], n - x[inner] - q[inner])
        ok = np.flatnonzero(q + ahead + back >= np.maximum(SHORTEST, TIMES * q))
        hits.append(np.unique(np.stack([x[ok] - back[ok], q[ok] + ahead[ok] + back[ok], q[ok]], 1), axis=0))
    if not hits:
        return np.zeros((0, 4), np.int64)
    runs = np.unique(np.concatenate(hits), axis=0)
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])[: len(runs)]]
    doc = np.searchsorted(bounds, runs[:, 0], "right") - 1
    out = np.column_stack([doc, runs[:, 0] - bounds[doc], runs[:, 1], runs[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def search(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(runs of `find`, collapsed texts) of texts in UTF-8."""
    split = [t.split() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    codes: dict[bytes, int] = defaultdict(lambda: len(codes))
    words = np.array([codes[w] for s in split for w in s], np.int64)
    runs = find(words, bounds)
    change = np.zeros(len(words) + 1, np.int64)
    at = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(change, at + runs[:, 3], 1)
    np.add.at(change, at + runs[:, 2], -1)
    keep = np.cumsum(change)[:-1] == 0
    out = []
    for k, s in enumerate(split):
        mask = keep[bounds[k] : bounds[k + 1]]
        out.append(b" ".join(s if mask.all() else [w for w, m in zip(s, mask.tolist()) if m]))
    return runs, out


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add a text's runs, an array of (start, length, period) by start and period, and the text with each run's first period only.

    Words lie between ASCII white space. A run is a stretch with smallest period p, of at least 6 words and 4p, that no neighbouring
    word extends. Collapsed: words of a run behind its first p go, the others are joined by one space. A null or empty text has no
    runs and collapses to an empty one. The other columns stay; columns of these two names are replaced. Rows are independent:
    nothing is shuffled, repeated rows stay. A text is searched whole, in n log n grid places and memory linear in n (a few ranks a word).
    """
    ship(docs)
    kept = [f for f in docs.schema.fields if f.name not in (runs, collapsed)]
    schema = StructType([*kept, StructField(runs, RUNS), StructField(collapsed, StringType())])

    def run(batches):
        for batch in batches:
            found, texts, base = [], [], 0
            for data, bounds in slices(batch.column(text), SLICE):
                got, out = search([data[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
                got[:, 0] += base
                base += len(out)
                found.append(got)
                texts += out
            all_ = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
            offsets = np.searchsorted(all_[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            kind = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
            items = pa.StructArray.from_arrays([pa.array(all_[:, k].copy()) for k in (1, 2, 3)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(offsets), items, type=pa.list_(pa.field("element", kind, False)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), lists, pa.array(texts, pa.binary()).cast(pa.string())], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def repeated_from(doc_id: Column, text: Column) -> Column:
    """The text that op 11 searches: of one document in ten (by crc32 of its id) the words from some place on repeat; others as they are. A null id changes nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def change(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    # the words as the variable of a function, so that they are made once a row
    words = F.array(F.regexp_extract_all(text, F.lit(f"({SPACE_WORD})"), F.lit(1)))
    return F.when(h % 10 == 0, F.get(F.transform(words, change), F.lit(0))).otherwise(text)


def op11(documents: DataFrame) -> DataFrame:
    """Digests of the runs and the collapsed text of each document, one in ten of them made periodic (see `repeated_from`)."""
    docs = documents.select("doc_id", repeated_from(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    got = periodic_runs(docs).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    got = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best")["length"], -F.col("best")["period"]
    return got.select("doc_id", "n_runs", (-F.col("best")["start"]).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
