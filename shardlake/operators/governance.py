"""Vocabularies, caches and queues: which labels are in use, what may be removed, what must be asked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(taxonomy: DataFrame) -> DataFrame:
    """Labels that are not retired."""
    return taxonomy.filter(~F.coalesce("retired", F.lit(False)))


def groups(taxonomy: DataFrame) -> DataFrame:
    """group, ids: active labels of each group in the order of their numbers, joined."""
    g = active(taxonomy).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("feature_id", "id"))).alias("x"))
    return g.select("group", F.array_join(F.transform("x", lambda s: s["id"]), ", ").alias("ids"))


def listing(taxonomy: DataFrame, shown: tuple = ("manufacture", "inclusion", "defect")) -> DataFrame:
    """feature_id, id, group and state of the labels of the groups shown."""
    state = F.when(F.coalesce("retired", F.lit(False)), "retired").otherwise("active")
    return taxonomy.filter(F.col("group").isin(*shown)).select("feature_id", "id", "group", state.alias("state"))


def precedence(taxonomy: DataFrame, order: list[str]) -> DataFrame:
    """id, place of the active labels: as ordered, the unlisted behind them by number."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("id")).cast("long") if order else F.lit(0).cast("long")
    return active(taxonomy).select("id", F.when(at > 0, at).otherwise(F.col("feature_id").cast("long") + len(order) + 1).alias("place"))


def usage(records: dict[str, DataFrame]) -> DataFrame:
    """label, places: where each label occurs, of named tables with a column `label`, as sorted text."""
    every = None
    for name, df in records.items():
        one = df.filter("label is not null").select("label", F.lit(name).alias("place")).distinct()
        every = one if every is None else every.union(one)
    return every.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("place")), ", ").alias("places"))


class InUse(ValueError):
    """A label that records refer to cannot be removed."""


def remove(taxonomy: DataFrame, label: str, used: DataFrame) -> DataFrame:
    """The taxonomy without a label; InUse if it, or a label numbered behind it, is used (numbers would move); ValueError if unknown."""
    row = taxonomy.filter(F.col("id") == label).select("feature_id").first()
    if row is None:
        raise ValueError(f"no label {label}")
    behind = taxonomy.filter(F.col("feature_id") >= row[0]).select("id")
    hit = [r[0] for r in used.join(behind, F.col("label") == F.col("id"), "left_semi").select("label").distinct().sort("label").limit(5).collect()]
    if hit:
        raise InUse(f"in use: {', '.join(hit)}")
    return taxonomy.filter(F.col("id") != label)


def retire(taxonomy: DataFrame, label: str, undo: bool = False) -> DataFrame:
    """The taxonomy with a label retired, or active again; its number and rows that refer to it stay."""
    return taxonomy.withColumn("retired", F.when(F.col("id") == label, F.lit(not undo)).otherwise(F.coalesce("retired", F.lit(False))))


def add(taxonomy: DataFrame, order: list[str], label: str, group: str, rule: str, before: str | None = None, after: str | None = None) -> tuple[DataFrame, list[str]]:
    """The taxonomy with a new label, numbered last, and the display order with it before or after another (before wins), else last."""
    if not taxonomy.filter(F.col("id") == label).isEmpty():
        raise ValueError(f"label {label} exists")
    top = taxonomy.agg(F.max("feature_id")).first()[0]
    row = taxonomy.sparkSession.createDataFrame([(0 if top is None else top + 1, label, group, rule, False)], "feature_id int, id string, group string, decision_rule string, retired boolean")
    place = order.index(before) if before in order else order.index(after) + 1 if after in order else len(order)
    return taxonomy.unionByName(row.select(*[F.col(c).cast(taxonomy.schema[c].dataType) for c in row.columns]), allowMissingColumns=True), [*order[:place], label, *order[place:]]


def cache_key(content: Column, prompt: str, run: Column, *how: str) -> Column:
    """Content address of an answer: md5 of the content, signature of the prompt, run, and what else decides it (size, provider, model)."""
    sign = F.substring(F.md5(F.lit(prompt)), 1, 6)
    return F.concat_ws("_", F.md5(content), sign, F.concat(F.lit("run"), run.cast("string")), *map(F.lit, how))


def misses(wanted: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key has no cached answer."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def valid_numbers(numbers: Column, k: Column) -> Column:
    """Whether a cached answer's numbers are all among 1 to k; none is valid too."""
    return F.forall(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= k))


def renumbered(local: Column, batch: Column, size: int) -> Column:
    """The number over all batches of a local one from 1: local + size * batch, batches from 0."""
    return local + F.lit(size) * batch


def answer_json(text: Column, schema: str) -> Column:
    """(value, parse_error) of a model's answer: the fenced part or the text itself, from the first brace to the last."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), "(?s)\\{.*\\}", 0)
    value = F.from_json(F.nullif(body, F.lit("")), schema)
    ok = F.coalesce(F.get_json_object(body, "$").isNotNull(), F.lit(False))
    return F.struct(F.when(ok, value).alias("value"), (~ok).alias("parse_error"))


def queue(found: DataFrame, done: DataFrame, key: str, force: bool = False, exclude: list[str] = []) -> DataFrame:
    """What a batch still has to do: found but not done (all with force), without the excluded."""
    left = found if force else found.join(done.select(key).distinct(), key, "left_anti")
    return left.filter(~F.col(key).cast("string").isin(*exclude)) if exclude else left


def archetype(ident: Column, names: dict[str, str]) -> Column:
    """(code, label) from an id of four parts parted by dashes: the third; unknown codes stand for themselves, other ids give null."""
    part = F.split(ident, "-")
    code = F.when(F.size(part) == 4, part[2])
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.struct(code.alias("code"), F.coalesce(F.try_element_at(table, F.coalesce(code, F.lit(""))), code).alias("label"))


def first_source(files: DataFrame, key: str, path: str, order: tuple = ("ply", "glb", "obj")) -> DataFrame:
    """key and its file of the first kind it has; ties go to the smaller path, other kinds are no source."""
    ext = F.lower(F.regexp_extract(path, "\\.([^.]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, order)), ext)
    return files.withColumn("_r", rank).filter("_r > 0").groupBy(key).agg(F.min_by(path, F.struct("_r", path)).alias(path))
