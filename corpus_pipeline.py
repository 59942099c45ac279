"""Corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlake.llm import decontam, langid, mixing, simhash, substring
from shardlake.llm.common import durable, held_out, table


#: Least share of a document's n-grams, corrected for false hits, that its language must hold. Documents of learned languages have
#: 0.69 and more (all documents of sf0.001 and sf0.01); of a language not learned, nine in ten have under 0.38 (sf0.01).
COVERAGE = 0.45


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language, by coverage; those without a letter (or null) go. The filters are learned from the other fold.

    A document must have COVERAGE in its language, or as much as that language's own documents usually have if they have less (langid.fit):
    each language is judged by itself. Without any n-gram of a learned language it goes, if there is a language of which coverage is asked at all. If no
    language was learned, all documents with a letter stay.
    """
    filters = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    if not filters.langs:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    asked = filters.least(COVERAGE)
    found = F.lit(not any(asked.values())) | (F.col("coverage") > 0)
    enough = F.col("coverage") >= F.create_map(*[F.lit(x) for kv in asked.items() for x in kv])[F.col("lang_pred")]
    whole = langid.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"), filters)
    return whole.filter((F.col("lang_pred") != "und") & found & enough).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays, null last; of rows that share it, the one with the smallest hash of text, then of all columns."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without their repeated runs; n_chars, if there is such a column, follows the text."""
    got = substring.dedup(docs)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.find(docs, table(spark, sf_dir, "benchmark")).filter("n_items = 0").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their repeats; the caller's columns size, source_size, target and repeats are replaced."""
    return mixing.mix(docs).filter("repeats > 0")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows lie in the shared folder until the next stage is written; those of the last one stay, as the result reads them."""
    docs = table(spark, sf_dir, "documents")
    durable(spark.range(0))  # the shared folder is known from here on
    root = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{root}/{name}"
    return docs
