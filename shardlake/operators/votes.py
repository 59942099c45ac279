"""Merging runs of votes and scoring label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(votes: DataFrame, item: str, feature: str, run: str) -> DataFrame:
    """(item, feature, votes) that more than half of all the item's runs name; a run counts once."""
    per = votes.groupBy(item, run).agg(F.collect_set(feature).alias("_f"))
    runs = per.groupBy(item).agg(F.count(F.lit(1)).alias("_runs"))
    seen = per.select(item, F.explode("_f").alias(feature)).groupBy(item, feature).agg(F.count(F.lit(1)).alias("votes"))
    return seen.join(runs, item).filter(F.col("votes") >= F.floor(F.col("_runs") / 2) + 1).drop("_runs")


def plurality(votes: DataFrame, item: str, label: str, order: str) -> DataFrame:
    """The commonest label of each item; of equals, the one seen first."""
    n = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_at"))
    return n.groupBy(item).agg(F.min_by(label, F.struct(-F.col("_n"), F.col("_at"))).alias(label), F.max("_n").alias("votes"))


def scores(pairs: DataFrame, feature: str, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, recall and precision of each feature from boolean columns; null where undefined."""
    t, p = F.col(truth), F.col(predicted)
    out = pairs.groupBy(feature).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    ratio = lambda c: F.try_divide(F.col("tp"), F.col("tp") + F.col(c))
    return out.withColumn("recall", ratio("fn")).withColumn("precision", ratio("fp"))


def null_model(items: DataFrame, truth: str, order: str, answers: int = 2) -> DataFrame:
    """One row of tp, fp, fn, recall and precision of the commonest labels, answered for every item whatever its truth set.

    Of equally common labels the one first seen by order wins (nulls last), then by position in the set, then by name;
    ratios without a denominator are 0.
    """
    each = items.select(F.col(order).alias("_o"), F.posexplode(truth).alias("_at", "_label"))
    n = each.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_o"), F.min("_at").alias("_at"))
    best = n.orderBy(F.desc("_n"), F.col("_o").asc_nulls_last(), "_at", "_label").limit(answers)
    total = items.agg(F.count(F.lit(1)).alias("_items"), F.coalesce(F.sum(F.size(truth)), F.lit(0)).cast("long").alias("_truth"))
    said = best.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("tp"), F.count(F.lit(1)).alias("_k"))
    tp, wide = F.col("tp"), total.crossJoin(said)
    out = wide.select("tp", (F.col("_k") * F.col("_items") - tp).alias("fp"), (F.col("_truth") - tp).alias("fn"))
    ratio = lambda c: F.coalesce(F.try_divide(tp, tp + F.col(c)), F.lit(0.0))
    return out.withColumn("recall", ratio("fn")).withColumn("precision", ratio("fp"))
