"""Nested records read from JSON with a stated schema; unreadable files give no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OUTCOME = "STRUCT<value: STRING, rule: STRING, note: STRING, reason: STRING, data_status: STRING>"
_CURVE = "STRUCT<mean_rad: DOUBLE, std_rad: DOUBLE, p25_rad: DOUBLE, p75_rad: DOUBLE, radius_mm: DOUBLE>"
#: What the queries and the rules read, stated: keys of maps are data, so inference is never used.
SCHEMA = f"""
fragment_id STRING, archetype STRING, computed_at STRING,
bounding STRUCT<obb_dims_mm: ARRAY<DOUBLE>, obb_axes_xyz: ARRAY<ARRAY<DOUBLE>>, volume_mm3: DOUBLE, volume_source: STRING,
  convexity: DOUBLE, mass_kg_est: DOUBLE, watertight: BOOLEAN>,
planarity ARRAY<STRUCT<normal_xyz: ARRAY<DOUBLE>, area_m2_est: DOUBLE, contiguous_area_m2: DOUBLE, n_patches: INT, fit_rms_mm: DOUBLE,
  angle_to_unscanned_deg: DOUBLE, scan_reliable: BOOLEAN, surface_label: STRING, features: ARRAY<STRING>, adjacent_features: ARRAY<STRING>,
  anomalies: ARRAY<STRUCT<label: STRING>>,
  procedural: STRUCT<connection_strategy: {_OUTCOME}, design_assignment: {_OUTCOME}, finishing_requirement: {_OUTCOME}, data_status: STRING>>>,
curvature STRUCT<fine_mm: {_CURVE}, coarse_mm: {_CURVE}>,
vision STRUCT<labels_present: ARRAY<STRING>, label_coverage: MAP<STRING, INT>, regions: ARRAY<STRUCT<region_id: INT, kind: STRING,
  plane_index: INT, area_frac: DOUBLE, area_m2: DOUBLE, contiguous_area_m2: DOUBLE, label: STRING, features: ARRAY<STRUCT<id: STRING, votes: INT>>,
  anomalies: ARRAY<STRUCT<label: STRING, box_pct: ARRAY<DOUBLE>>>, n_features: INT, n_label_votes: INT, uv_coherence: DOUBLE, uv_fill: DOUBLE,
  smear_frac: DOUBLE, flat_frac: DOUBLE, colour_entropy_bits: DOUBLE, skipped: STRING>>>,
scan_coverage STRUCT<has_unscanned_face: BOOLEAN, unscanned_avg_normal: ARRAY<DOUBLE>>,
procedural STRUCT<handling_class: {_OUTCOME}, drill_zone: STRUCT<value: STRING, rule: STRING, reason: STRING, data_status: STRING, clear_core_mm_est: DOUBLE,
    cover_mm_assumed: DOUBLE, entry_faces: ARRAY<INT>>,
  use_suggestions: ARRAY<STRUCT<id: STRING, label: STRING, faces: ARRAY<INT>, regions: ARRAY<INT>, note: STRING, caveat: STRING>>,
  faces_evaluated: INT, data_status: STRING, basis: STRING, note: STRING>
"""


def _read(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.schema(SCHEMA + ", _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def read_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Records of the files of a folder whose names match (all if not told). Queries order by fragment_id, which names the files."""
    return _read(spark, path, glob).filter(F.col("fragment_id").isNotNull()).drop("_corrupt_record")


def unreadable(spark: SparkSession, path: str, glob: str | None = None) -> list[str]:
    """Names of files that hold no record, sorted: for a warning, as read_records leaves them out."""
    rows = _read(spark, path, glob).filter(F.col("fragment_id").isNull()).select(F.col("_metadata.file_name").alias("f")).distinct()
    return [r[0] for r in rows.sort("f").collect()]


def faces(records: DataFrame) -> DataFrame:
    """One row a face: fragment_id, plane (its place from 0) and its fields; records without faces give none."""
    return records.select("fragment_id", F.posexplode("planarity").alias("plane", "face")).select("fragment_id", "plane", "face.*")


def regions(records: DataFrame) -> DataFrame:
    """One row a region: fragment_id and its fields; records without regions give none."""
    return records.select("fragment_id", F.explode("vision.regions").alias("region")).select("fragment_id", "region.*")


def label_set(cell: Column) -> Column:
    """The labels of a cell, parted by any comma or semicolon, each once; empty for `none` alone, null if empty or said to be unusable."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), "[,;\uFF0C\u3001]"), lambda x: F.trim(x))
    labels = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.when((F.size(labels) > 0) & ~F.array_contains(labels, "unusable"), F.array_remove(labels, "none"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """tile, fragment, features of label sheets (CSV): cells parted by any comma or semicolon; `none` alone is the empty set.

    Rows whose cell is empty or says `unusable` are left out; repeated labels count once.
    """
    sheet = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return sheet.select("tile", "fragment", label_set(F.col("true_features")).alias("features")).filter("features is not null")


def unknown_labels(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """feature, state (unknown or retired) and tiles of labels that the taxonomy (id, retired) does not hold as active: they count as missed."""
    used = labels.select("tile", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_distinct("tile").alias("tiles"))
    known = taxonomy.select(F.col("id").alias("_id"), F.coalesce("retired", F.lit(False)).alias("_retired"))
    both = used.join(known, F.col("feature") == F.col("_id"), "left").filter("_id is null or _retired")
    return both.select("feature", F.when(F.col("_id").isNull(), "unknown").otherwise("retired").alias("state"), "tiles")


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """batch, run, region, feature of cached vote files named reg_<batch>_run<digit>_...; elements are ids or objects with an id."""
    raw = spark.read.text(path, wholetext=True).withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), "reg_(.+)_run(\\d)_", 0))
    raw = raw.filter("_file <> ''").select(F.regexp_extract("_file", "reg_(.+)_run(\\d)_", 1).alias("batch"), F.regexp_extract("_file", "_run(\\d)_", 1).cast("int").alias("run"), F.from_json("value", "map<string, string>").alias("m"))
    per = raw.select("batch", "run", F.explode("m").alias("region", "answer")).filter("region rlike '^[0-9]+$'")
    votes = per.select("batch", "run", F.col("region").cast("int").alias("region"), F.explode(F.from_json(F.get_json_object("answer", "$.features"), "array<string>")).alias("x"))
    return votes.select("batch", "run", "region", F.coalesce(F.get_json_object("x", "$.id"), "x").alias("feature")).distinct()


def write_records(records: DataFrame, path: str) -> None:
    """One JSON file a fragment, in a folder of its own; folders of other fragments stay."""
    one = records.withColumn("fragment", F.col("fragment_id")).repartition("fragment")
    one.write.partitionBy("fragment").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """CSV with a header: disagreements, label sheets."""
    rows.write.mode("overwrite").option("header", True).csv(path)
