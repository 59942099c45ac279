"""Language identification with bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import durable, held_out, ship

#: The filters are learned from at most SAMPLE documents of each language (the smallest hashes of doc_id and text).
SAMPLE, HASHES, N = 400, 3, 4
#: Slots a learned n-gram of the largest language: with HASHES of them set for each, one in seven slots has that language's bit.
SLOTS = 20
#: Share of a language's own documents that may lie under the least coverage asked of it.
ERROR = 0.05
#: Most chosen documents (two longs each) of a broadcast list; more are joined by a shuffle.
BROADCAST = 200_000


def ngrams(text: str, n: int = N) -> list[str]:
    """Distinct words and character n-grams of the padded lower-case words; digits and signs split words."""
    out: set[str] = set()
    for w in set("".join(c if c.isalpha() else " " for c in text.lower()).split()):
        p = f" {w} "
        out.add(p)
        out.update(p[i : i + n] for i in range(len(p) - n + 1))
    return sorted(out)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES slots of each hashed n-gram, by double hashing."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


def hashed(grams: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), dtype=np.uint64, count=len(grams))


class Filters:
    """A bitmask of languages per slot, of as many 64-bit words as they need; the AND of an n-gram's slots holds all languages that contain it."""

    def __init__(self, learned: dict[str, np.ndarray]):
        """learned: hashed n-grams by language."""
        self.langs = sorted(learned)
        most = max((len(g) for g in learned.values()), default=1)
        self.bits = 1 << max(10, (SLOTS * most - 1).bit_length())
        self.slots = np.zeros((-(-len(self.langs) // 64), self.bits), dtype=np.uint64)
        self.usual = dict.fromkeys(self.langs, 0.0)
        for k, lang in enumerate(self.langs):
            self.slots[k // 64][positions(learned[lang], self.bits).ravel()] |= np.uint64(1 << k % 64)
        fill = np.array([((self.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.langs))])
        self.false = np.minimum(fill**HASHES, 0.99)

    def least(self, most: float) -> dict[str, float]:
        """Coverage asked of a document of each language: `most`, or less where the language's own documents have less. No language's depends on another's."""
        return {k: min(most, v) for k, v in self.usual.items()}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share of all corrected hits, and its corrected hits per n-gram."""
        grams = ngrams(text or "")
        if not grams or not self.langs:
            return "und", 0.0, 0.0
        at = positions(hashed(grams), self.bits)
        n = len(grams)
        hits = []
        for k in range(len(self.langs)):
            if k % 64 == 0:
                word = self.slots[k // 64]
                mask = word[at[0]]
                for row in at[1:]:
                    mask = mask & word[row]
            hits.append(np.count_nonzero(mask & np.uint64(1 << k % 64)))
        real = np.clip((np.array(hits) - n * self.false) / (1 - self.false), 0, None)
        best = int(real.argmax())
        total = real.sum()
        return self.langs[best], float(real[best] / total) if total else 0.0, float(min(1.0, real[best] / n))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters of all n-grams of a bounded sample of each language.

    One pass counts the languages and one chooses documents whose hash lies under a threshold that some twice the sample pass, of
    which the smallest hashes are ranked; both carry no texts. Texts of the chosen ones are then fetched by key, and each distinct
    n-gram of a language comes to the driver as a hash and a count. What the driver gets grows with the languages, not with the documents.

    usual: the coverage of a language's sampled documents by the others of them (each one's share of n-grams that some other holds), the
    quantile ERROR, times 1 - 1 / sqrt(n) for n different ones: the fewer there are, the less is asked of a text, and nothing where there is one.
    """
    ship(docs)
    rows = docs.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("_h"))
    counts = durable(rows.groupBy(F.col("lang").alias("_l")).agg(F.count(F.lit(1)).alias("_n")))
    share = F.pmod(F.col("_h"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    near = rows.select("lang", "_h").join(F.broadcast(counts) if counts.count() <= BROADCAST else counts, F.col("lang") == F.col("_l")).filter(share * F.col("_n") <= 2 * sample)
    best = Window.partitionBy("lang").orderBy("_h")
    chosen = durable(near.select("lang", "_h").distinct().withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= sample).select(F.col("lang").alias("_l"), F.col("_h").alias("_k")))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen
    texts = rows.join(chosen, (F.col("lang") == F.col("_l")) & (F.col("_h") == F.col("_k")), "left_semi").select("lang", "_h", "text")

    def cut(batches):
        for b in batches:
            d = b.to_pydict()
            h = [hashed(ngrams(t)).view(np.int64) for t in d["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(d["lang"], b.schema.field(0).type), pa.array(d["_h"], pa.int64()), pa.array(h, pa.list_(pa.int64()))], names=["lang", "_h", "g"])

    grams = texts.mapInArrow(cut, StructType([texts.schema["lang"], texts.schema["_h"]]).add("g", ArrayType(LongType())))
    # Texts of the same n-grams are one: copies would say that a language is well known. The n-grams are kept, so that the sample's texts are read once.
    own = durable(grams.select("lang", "_h", "g", F.xxhash64("g").alias("_g")).dropDuplicates(["lang", "_g"]).drop("_g"))
    seen = own.select("lang", "_h", F.explode("g").alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("of"))
    learned: dict[str, list] = {r[0]: [] for r in counts.select("_l").collect()}
    alone: Counter = Counter()
    for lang, g, n, of in seen.collect():
        learned[lang].append(g)
        if n == 1:
            alone[lang, of] += 1
    filters = Filters({k: np.array(sorted(g), dtype=np.int64).view(np.uint64) for k, g in learned.items()})
    shares = defaultdict(list)
    for lang, of, n in own.select("lang", "_h", F.size("g")).collect():
        if n:
            shares[lang].append(1 - alone[lang, of] / n)
    for lang, x in shares.items():
        filters.usual[lang] = float(np.quantile(x, ERROR)) * (1 - len(x) ** -0.5)
    return filters


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Add lang_pred, score and coverage to every document (columns of these names are replaced).

    `und` with score 0: null and empty texts, and those without a letter. Rows are scored one by one from
    their whole text, however long (memory is that of its distinct n-grams); ties go to the language that sorts first; without any learned language all are `und`.
    """
    ship(docs)
    lean = docs.drop("lang_pred", "score", "coverage")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the sample and the languages

    fields = StructType([*lean.schema.fields]).add("lang_pred", "string").add("score", "double").add("coverage", "double")
    return lean.mapInArrow(lambda batches: _arrow(batches, shared), fields)


def _arrow(batches, shared):
    for b in batches:
        got = [shared.value.predict(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "lang_pred", "score", "coverage"])


def op3(documents: DataFrame) -> DataFrame:
    filters = fit(documents.filter(~held_out(F.col("doc_id"))))
    got = identify(documents.select("doc_id", "text"), filters)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
