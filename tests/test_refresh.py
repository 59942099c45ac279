"""Refreshing a store: only what changed is derived and written; dry runs and failed runs leave it as it was."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shardlake.operators import design
from shardlake.plans.records import RULES
from shardlake.sources import refresh as store
from shardlake.sources.records import SCHEMA

def record(name, mass, rms=1.0):
    face = {"area_m2_est": 50.0, "fit_rms_mm": rms, "procedural": {"data_status": "old"}}
    return {"fragment_id": name, "bounding": {"obb_dims_mm": [400.0, 300.0, 90.0], "mass_kg_est": mass}, "planarity": [face]}


def derive(rows, rules):
    return design.derive(rows, rules)


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_refresh(spark, tmp_path):
    path = f"{tmp_path}/store"
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = [record("a", 100.0), record("b", 5000.0), record("c", None), record(None, 1.0)]
    dry = {r.fragment_id: (r.state, r.added, r.handling) for r in store.refresh(table(first), path, RULES, derive, dry_run=True).collect()}
    assert dry == {"a": ("new", ["bench"], "manual"), "b": ("new", ["bench"], "two_person"), "c": ("new", ["bench"], None)} and files(path) == []
    assert store.current(spark, path) is None and store.last_commit(spark, path) == 0
    assert {r.fragment_id: (r.state, r.added, r.handling) for r in store.refresh(table(first), path, RULES, derive).collect()} == dry
    assert store.last_commit(spark, path) == 1 and {r.fragment_id: r.handling for r in store.current(spark, path).select("fragment_id", F.col("procedural.handling_class.value").alias("handling")).collect()} == {"a": "manual", "b": "two_person", "c": None}
    before = files(path)
    assert store.refresh(table(first), path, RULES, derive).count() == 0 and files(path) == before
    # derived fields are no part of what a record is
    again = [r | {"procedural": {"basis": "whatever"}} for r in first]
    assert store.refresh(table(again), path, RULES, derive).count() == 0 and files(path) == before

    second = [record("a", 100.0), record("b", 5000.0, rms=9.0), record("d", 1.0)]
    with pytest.raises(Exception, match="broken"):
        store.refresh(table(second), path, RULES, lambda rows, rules: derive(rows, rules).withColumn("archetype", F.raise_error(F.lit("broken")).cast("string")))
    assert store.last_commit(spark, path) == 1 and {r[0] for r in store.current(spark, path).select("fragment_id").collect()} == {"a", "b", "c"}
    got = {r.fragment_id: (r.state, r.added, r.gone) for r in store.refresh(table(second), path, RULES, derive).collect()}
    assert got == {"b": ("changed", [], ["bench"]), "c": ("removed", [], ["bench"]), "d": ("new", ["bench"], [])}
    now = store.current(spark, path)
    assert {r.fragment_id: r.u for r in now.select("fragment_id", F.transform("procedural.use_suggestions", lambda u: u["id"]).alias("u")).collect()} == {"a": ["bench"], "b": [], "d": ["bench"]}
    # other rules change every record
    rules = RULES | {"use_suggestions": {"rules": []}}
    assert {r.state for r in store.refresh(table(second), path, rules, derive).collect()} == {"changed"} and store.last_commit(spark, path) == 3
    assert store.refresh(table([]), path, rules, derive).count() == 3 and store.current(spark, path) is None


def test_commits_with_long_fingerprints_are_known(spark, tmp_path):
    path = f"{tmp_path}/store"
    table = spark.createDataFrame([record("a", 100.0), record("b", 5000.0)], SCHEMA)
    assert store.refresh(table, path, RULES, derive).count() == 2
    long = spark.read.parquet(f"{path}/commits/1").withColumn("fingerprint", F.lower(F.hex(F.unbase64("fingerprint")))).localCheckpoint()
    long.write.mode("overwrite").parquet(f"{path}/commits/1")
    before = files(path)
    assert {len(r.fingerprint) for r in long.collect()} == {64} and store.refresh(table, path, RULES, derive).count() == 0 and files(path) == before


def test_a_dry_run_says_what_a_run_says(spark, tmp_path):
    path = f"{tmp_path}/store"
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store.refresh(table([record("a", 100.0), record("b", 5000.0), record("c", 1.0)]), path, RULES, derive)
    second = table([record("a", 100.0), record("b", 5000.0, rms=9.0), record("d", 1.0)])
    before = files(path)
    dry = sorted(map(tuple, store.refresh(second, path, RULES, derive, dry_run=True).collect()))
    assert [r[:2] for r in dry] == [("b", "changed"), ("c", "removed"), ("d", "new")] and files(path) == before
    assert sorted(map(tuple, store.refresh(second, path, RULES, derive).collect())) == dry
    assert not [f for f in files(path) if "/staged/" in f]
