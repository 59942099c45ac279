"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held_out, ship

#: The labels of at most SAMPLE documents (smallest hashes of doc_id) train the model.
SAMPLE, WORDS, RANK, EPOCHS = 4000, 1 << 12, 6, 12
STATS = 12
FIELDS = WORDS + STATS


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: log-scaled, normalised word counts, then statistics of structure, then the stated length."""
    text = text or ""
    words = text.split()
    n, c = max(len(words), 1), max(len(text), 1)
    counts: dict[int, float] = {}
    for w in words:
        j = xxhash.xxh32_intdigest(w.lower()) % WORDS
        counts[j] = counts.get(j, 0) + 1
    idx = np.array(sorted(counts), dtype=np.int64)
    val = np.log1p(np.array([counts[j] for j in idx], dtype=float)) if len(idx) else np.zeros(0)
    if len(idx):
        val /= np.linalg.norm(val)
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text))
    stats = [
        letters / c, sum(map(str.isupper, text)) / max(letters, 1), sum(map(str.isdigit, text)) / c, len(re.findall(r"[^\w\s]", text)) / c * 4,
        len(set(words)) / n, len(set(lines)) / len(lines), min(n / len(lines) / 100, 2), letters / n / 10, text.count("|") / n, text.count("!") / n,
        math.log1p(n) / 10, math.log1p(max(n_chars or 0, 0)) / 12,
    ]
    return np.concatenate([idx, np.arange(WORDS, FIELDS)]), np.concatenate([val, np.array(stats)])


class Machine:
    """w0 + <w, x> + half of (sum of V x) squared less the sum of squares: linear in the features present."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(FIELDS), r.normal(0, 0.05, (FIELDS, RANK))

    def margin(self, idx, val):
        vx = self.v[idx] * val[:, None]
        s = vx.sum(0)
        return self.w0 + self.w[idx] @ val + 0.5 * float(s @ s - (vx * vx).sum()), vx, s

    def score(self, text, n_chars) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(*features(text, n_chars))[0]))))

    def fit(self, rows, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
        """Adagrad on the log loss; rows are (indices, values, label)."""
        if not rows:
            return self
        r = np.random.default_rng(seed)
        g0, gw, gv = 1e-6, np.full(FIELDS, 1e-6), np.full((FIELDS, RANK), 1e-6)
        mean = min(max(sum(y for *_, y in rows) / len(rows), 0.01), 0.99)
        self.w0 = math.log(mean / (1 - mean))
        for _ in range(epochs):
            for at in r.permutation(len(rows)):
                idx, val, y = rows[at]
                m, vx, s = self.margin(idx, val)
                e = 1 / (1 + math.exp(-max(-30.0, min(30.0, m)))) - y
                dw = e * val + decay * self.w[idx]
                dv = e * (val[:, None] * s - vx * val[:, None]) + decay * self.v[idx]
                g0 += e * e
                gw[idx] += dw * dw
                gv[idx] += dv * dv
                self.w0 -= rate * e / math.sqrt(g0)
                self.w[idx] -= rate * dw / np.sqrt(gw[idx])
                self.v[idx] -= rate * 0.5 * dv / np.sqrt(gv[idx])
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the sample; features, not texts, come to the driver. Null labels or ids are no examples; no example, no slope."""
    ship(docs)
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    known = known.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select(F.xxhash64("doc_id", "text").alias("_key"), "text", F.col("n_chars").cast("long").alias("n_chars"), "_y")

    def extract(batches):
        for b in batches:
            d = b.to_pydict()
            f = [features(t, n) for t, n in zip(d["text"], d["n_chars"])]
            yield pa.RecordBatch.from_arrays([pa.array(d["_key"], pa.int64()), pa.array([x.tolist() for x, _ in f], pa.list_(pa.int64())), pa.array([v.tolist() for _, v in f], pa.list_(pa.float64())), pa.array(d["_y"], pa.int32())], names=["d", "i", "v", "y"])

    got = rows.mapInArrow(extract, "d long, i array<long>, v array<double>, y int").collect()
    got.sort(key=lambda r: (r["d"], r["y"], r["v"]))
    return Machine().fit([(np.array(r["i"]), np.array(r["v"]), r["y"]) for r in got])


def rate(docs: DataFrame, model: Machine) -> DataFrame:
    """Add quality_score (0 to 1) from text and n_chars; null and empty texts score by their statistics alone."""
    ship(docs)
    lean = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FIELDS rows, at any input size

    def run(batches):
        for b in batches:
            t, n = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "n_chars"))
            s = pa.array([shared.value.score(x, y) for x, y in zip(t, n)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, "quality_score"])

    return lean.mapInArrow(run, StructType([*lean.schema.fields]).add("quality_score", "double"))


def op6(documents: DataFrame, labels: DataFrame) -> DataFrame:
    d = documents.select("doc_id", "text", "n_chars")
    got = rate(d, train(d, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))
