"""Small configurations: rules, vocabularies and settings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAXONOMY = "feature_id INT, id STRING, `group` STRING, decision_rule STRING, retired BOOLEAN"


def _text(spark: SparkSession, path: str) -> str | None:
    """A whole small file by Spark's readers, null if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def read_rules(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """The rule file; the default (empty if not given) where it is missing."""
    text = _text(spark, path)
    return json.loads(text) if text is not None else (default or {})


def read_taxonomy(spark: SparkSession, path: str, default: list[tuple] = []) -> DataFrame:
    """The labels of a taxonomy file ({"labels": [...]}); the default rows where it is missing. Absent fields are null, absent retirement is false."""
    text = _text(spark, path)
    rows = [tuple(x.get(k) for k in ("feature_id", "id", "group", "decision_rule", "retired")) for x in json.loads(text).get("labels", [])] if text is not None else default
    return spark.createDataFrame(rows, TAXONOMY).withColumn("retired", F.coalesce("retired", F.lit(False)))


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY=value lines of a settings file, without comments and quotes; the environment overrides them. A missing file has none."""
    out = {}
    for line in (_text(spark, path) or "").splitlines():
        key, sign, value = line.partition("=")
        if sign and not key.strip().startswith("#"):
            out[key.strip()] = os.environ.get(key.strip(), value.strip().strip("'\""))
    return out
