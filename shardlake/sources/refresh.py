"""Records derived again only where they or the rules have changed, in commits: a failed run leaves the last state as it was.

A store is a folder with `records/<batch>` (derived records) and `commits/<number>` (fragment_id, fingerprint and batch of every record). Its state is the highest
commit that was written to the end; batches that no commit names are leftovers of failed runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "fragment_id string, fingerprint string, batch string"
_REPORT = "fragment_id string, state string, added array<string>, gone array<string>, handling string"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def last_commit(spark: SparkSession, store: str) -> int:
    """The number of the last whole commit, 0 before the first."""
    fs, p = _path(spark, f"{store}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [int(n) for n in names if n.isdigit() and fs.exists(_path(spark, f"{store}/commits/{n}/_SUCCESS")[1])]
    return max(done, default=0)


def _short(digest: Column) -> Column:
    """A digest's hexadecimal digits in base 64: a store holds it twice a record, and it does not compress."""
    return F.base64(F.unhex(digest))


def _manifest(spark: SparkSession, store: str, number: int) -> DataFrame:
    rows = spark.read.schema(_COMMIT).parquet(f"{store}/commits/{number}")
    # commits of earlier versions hold fingerprints in hexadecimal digits
    return rows.withColumn("fingerprint", F.when(F.length("fingerprint") == 64, _short(F.col("fingerprint"))).otherwise(F.col("fingerprint")))


def _held(spark: SparkSession, store: str, named: DataFrame) -> DataFrame | None:
    """The derived records that a table (fragment_id, batch) names, from these batches; None if it names none."""
    batches = [r[0] for r in named.select("batch").distinct().collect()]  # one a commit
    rows = None
    for b in batches:
        part = spark.read.parquet(f"{store}/records/{b}").withColumn("_batch", F.lit(b))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return None
    return rows.join(named.select("fragment_id", F.col("batch").alias("_of")), "fragment_id").filter("_batch = _of").drop("_batch", "_of")


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The derived records of the last commit; None before the first."""
    number = last_commit(spark, store)
    return _held(spark, store, _manifest(spark, store, number)) if number else None


def fingerprinted(records: DataFrame, rules: dict, derived: tuple[str, ...] = ("procedural",)) -> DataFrame:
    """Add fingerprint: a digest of the record's own fields, without the derived ones of record and faces, and of the rules."""
    own = [F.col(f"`{c}`").alias(c) for c in records.columns if c not in (*derived, "planarity")]
    if "planarity" in records.columns:
        own.append(F.transform("planarity", lambda f: f.dropFields("procedural")).alias("planarity"))
    body = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    return records.withColumn("fingerprint", _short(F.sha2(F.concat_ws("\n", F.lit(json.dumps(rules, sort_keys=True)), body), 256)))


def _uses(column: str):
    return F.coalesce(F.transform(F.col(column)["use_suggestions"], lambda u: u["id"]), F.array().cast("array<string>"))


def _differing(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Records that are new, changed or removed, with _state and the batch that held them; of the removed there is only the name.

    All three come from one join, so the records are made once. It builds on the slim side, as records are wide to sort; records that lie by
    fragment_id already stay where they are.
    """
    if before is None:
        return now.withColumn("_state", F.lit("new")).withColumn("_of", F.lit(None).cast("string"))
    old = before.select(F.col("fragment_id").alias("_id"), F.col("fingerprint").alias("_print"), F.col("batch").alias("_of"))
    both = now.join(old.hint("shuffle_hash"), F.col("fragment_id") == F.col("_id"), "full_outer")
    state = F.when(F.col("_id").isNull(), "new").when(F.col("fragment_id").isNull(), "removed").when(F.col("fingerprint") != F.col("_print"), "changed")
    return both.withColumn("_state", state).filter("_state is not null").withColumn("fragment_id", F.coalesce("fragment_id", "_id")).drop("_id", "_print")


def refresh(records: DataFrame, store: str, rules: dict, derive: Callable[[DataFrame, dict], DataFrame], dry_run: bool = False) -> DataFrame:
    """Bring the store up to the records and rules; returns fragment_id, state (new, changed, removed), added and gone uses, handling of what differs.

    Only records whose fingerprint is new or another are derived and written, as one batch; then the commit is. Where nothing differs nothing is
    written. A dry run derives the same and writes nothing. fragment_id is unique; records without one take no part. After the first commit
    what differs is kept in `staged/<batch>` while the refresh runs.
    """
    spark = records.sparkSession
    number = last_commit(spark, store)
    before = _manifest(spark, store, number) if number else None
    batch = uuid4().hex
    other = _differing(fingerprinted(records.filter("fragment_id is not null"), rules), before)
    if dry_run:
        return _report(other, derive(_present(other), rules), None if before is None else _held(spark, store, before))
    try:
        if before is not None:
            other.write.parquet(f"{store}/staged/{batch}")
            other = spark.read.schema(other.schema).parquet(f"{store}/staged/{batch}")
        return _commit(other, before, store, number + 1, batch, rules, derive)
    finally:
        _delete(spark, f"{store}/staged/{batch}")


def _present(other: DataFrame) -> DataFrame:
    return other.filter("_state <> 'removed'").drop("_of")


def _commit(other: DataFrame, before: DataFrame | None, store: str, number: int, batch: str, rules: dict, derive: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """Write the batch of what differs, the report and then the commit; returns the report."""
    spark = other.sparkSession
    fresh = derive(_present(other), rules)
    none = before is not None and other.isEmpty()
    if not none:
        fresh.write.parquet(f"{store}/records/{batch}")
        fresh = spark.read.schema(fresh.schema).parquet(f"{store}/records/{batch}")
        none = before is None and fresh.isEmpty()
    if none:
        _delete(spark, f"{store}/records/{batch}")
        return spark.createDataFrame([], _REPORT)
    named = fresh.select("fragment_id", "fingerprint", F.lit(batch).alias("batch"))
    if before is None:
        report = _report(None, fresh, None)
    else:
        report = _report(other, fresh, _held(spark, store, other.select("fragment_id", F.col("_of").alias("batch")).filter("batch is not null")))
        named = before.join(other.select("fragment_id"), "fragment_id", "left_anti").unionByName(named)
    report.write.parquet(f"{store}/reports/{batch}")
    named.write.mode("overwrite").parquet(f"{store}/commits/{number}")
    return spark.read.schema(report.schema).parquet(f"{store}/reports/{batch}")


def _report(other: DataFrame | None, fresh: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """What a refresh returns, from what differs (None: nothing was removed), the records derived anew and those held earlier."""
    none = F.array().cast("array<string>")
    report = fresh.select("fragment_id", F.col("_state").alias("state"), _uses("procedural").alias("_uses"), F.col("procedural.handling_class.value").alias("handling"))
    if other is not None:
        gone = other.filter("_state = 'removed'")
        report = report.unionByName(gone.select("fragment_id", F.col("_state").alias("state"), none.alias("_uses"), F.lit(None).cast("string").alias("handling")))
    if earlier is None:
        report = report.withColumn("_was", none)
    else:
        was = earlier.select(F.col("fragment_id").alias("_id"), _uses("procedural").alias("_was"))
        report = report.join(was, F.col("fragment_id") == F.col("_id"), "left").withColumn("_was", F.coalesce("_was", none))
    return report.select("fragment_id", "state", F.array_except("_uses", "_was").alias("added"), F.array_except("_was", "_uses").alias("gone"), "handling")
