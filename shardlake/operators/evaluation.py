"""Scoring label sets, agreement of runs and merging of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratios(df: DataFrame, empty: float | None = None) -> DataFrame:
    ratio = lambda c: F.try_divide(F.col("tp"), F.col("tp") + F.col(c))
    keep = (lambda c: F.coalesce(c, F.lit(empty))) if empty is not None else (lambda c: c)
    return df.withColumn("recall", keep(ratio("fn"))).withColumn("precision", keep(ratio("fp")))


def _counts(truth: Column, said: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    t, p = F.coalesce(truth, none), F.coalesce(said, none)
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return [total(F.array_intersect(p, t)).alias("tp"), total(F.array_except(p, t)).alias("fp"), total(F.array_except(t, p)).alias("fn")]


def micro(items: DataFrame, truth: str = "truth", said: str = "said", by: tuple = ()) -> DataFrame:
    """tp, fp, fn, recall, precision (0 where undefined), exact and items over label sets, in all or by columns such as a vote's number.

    Null sets are empty. Without rows there is one row of zeros (none with `by`).
    """
    none = F.array().cast("array<string>")
    same = F.array_sort(F.array_distinct(F.coalesce(F.col(truth), none))) == F.array_sort(F.array_distinct(F.coalesce(F.col(said), none)))
    out = items.groupBy(*by).agg(*_counts(F.col(truth), F.col(said)), F.count_if(same).alias("exact"), F.count(F.lit(1)).alias("items"))
    return _ratios(out, 0.0)


def by_feature(items: DataFrame, truth: str = "truth", said: str = "said") -> DataFrame:
    """feature, tp, fp, fn, recall and precision (null where undefined) of every feature that is true or said somewhere."""
    none = F.array().cast("array<string>")
    every = F.array_union(F.coalesce(F.col(truth), none), F.coalesce(F.col(said), none))
    one = items.select(F.explode(every).alias("feature"), truth, said)
    t, p = (F.coalesce(F.array_contains(c, F.col("feature")), F.lit(False)) for c in (truth, said))
    return _ratios(one.groupBy("feature").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")))


def probe(items: DataFrame, features: list[str], answers: DataFrame, item: str, truth: str = "truth") -> DataFrame:
    """feature, truth, tp, fp, fn of yes-or-no answers (item, feature, yes): every asked feature is counted, true anywhere or not.

    A missing or null answer is no. Features are a stated list; items meet them as an array, without a join.
    """
    asked = items.select(item, truth, F.explode(F.array(*map(F.lit, features))).alias("feature"))
    said = answers.select(F.col(item).alias("_i"), F.col("feature").alias("_f"), F.col("yes").alias("_yes"))
    both = asked.join(said, (F.col(item) == F.col("_i")) & (F.col("feature") == F.col("_f")), "left")
    t, p = F.coalesce(F.array_contains(truth, F.col("feature")), F.lit(False)), F.coalesce("_yes", F.lit(False))
    return both.groupBy("feature").agg(F.count_if(t).alias("truth"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def disagreements(items: DataFrame, item: str, truth: str = "truth", said: str = "said") -> DataFrame:
    """item, feature, kind (FP or FN) and the truth as sorted text, one row a wrong feature of an item."""
    none = F.array().cast("array<string>")
    t, p = F.coalesce(F.col(truth), none), F.coalesce(F.col(said), none)
    wrong = lambda c, kind: F.transform(c, lambda f: F.struct(f.alias("feature"), F.lit(kind).alias("kind")))
    both = F.concat(wrong(F.array_except(p, t), "FP"), wrong(F.array_except(t, p), "FN"))
    return items.select(item, F.explode(both).alias("w"), F.array_join(F.array_sort(t), ", ").alias("truth")).select(item, "w.feature", "w.kind", "truth")


def recovery(items: DataFrame, filed: str, said: str) -> DataFrame:
    """filed, items, found, rate: how often the label an exemplar is filed under is among its answers."""
    hit = F.coalesce(F.array_contains(said, F.col(filed)), F.lit(False))
    return items.filter(F.col(filed).isNotNull()).groupBy(F.col(filed).alias("filed")).agg(F.count(F.lit(1)).alias("items"), F.count_if(hit).alias("found"), F.avg(hit.cast("double")).alias("rate"))


def observed(votes: DataFrame, batch: str, item: str, feature: str, run: str, least: int = 3) -> DataFrame:
    """batch, item, feature, votes and runs of the batches with `least` runs or more; a run names a feature of an item once."""
    runs = votes.groupBy(batch).agg(F.count_distinct(run).alias("runs")).filter(F.col("runs") >= least)
    seen = votes.filter(F.col(feature).isNotNull()).groupBy(batch, item, feature).agg(F.count_distinct(run).alias("votes"))
    return seen.join(runs, batch)


def agreement(votes: DataFrame, batch: str, item: str, feature: str, run: str) -> DataFrame:
    """feature, all3, two, one and the share of each among them: in how many runs a feature of an item was seen, over complete batches.

    Counts beyond three runs count nowhere. Most frequent features first.
    """
    n = observed(votes, batch, item, feature, run).groupBy(F.col(feature).alias("feature")).agg(*[F.count_if(F.col("votes") == k).alias(name) for k, name in ((3, "all3"), (2, "two"), (1, "one"))])
    total = F.col("all3") + F.col("two") + F.col("one")
    shares = [F.try_divide(F.col(c), total).alias(f"{c}_share") for c in ("all3", "two", "one")]
    return n.select("*", *shares).orderBy(total.desc(), "feature")


def combinations(votes: DataFrame, batch: str, item: str, feature: str, run: str) -> DataFrame:
    """combination (features that most runs name, sorted and joined; may be empty), items and share, commonest first."""
    seen = observed(votes, batch, item, feature, run)
    keep = F.when(F.col("votes") > F.floor(F.col("runs") / 2), F.col(feature))
    sets = seen.groupBy(batch, item).agg(F.array_join(F.array_sort(F.collect_set(keep)), ", ").alias("combination"))
    n = sets.groupBy("combination").agg(F.count(F.lit(1)).alias("items"))
    total = n.agg(F.sum("items")).first()[0] or 1
    return n.withColumn("share", F.col("items") / F.lit(total)).orderBy(F.desc("items"), "combination")


def merged(votes: DataFrame, items: DataFrame, item: str, feature: str, run: str, active: list[str], precedence: list[str]) -> DataFrame:
    """item, features, n_runs: every item's features that more than half of its runs name, in display order.

    Features that are not active are dropped before the count; an item may end with none. Those the order does not list come last, by id.
    """
    runs = votes.groupBy(item).agg(F.count_distinct(run).alias("n_runs"))
    n = votes.filter(F.col(feature).isin(active)).groupBy(item, feature).agg(F.count_distinct(run).alias("n")).join(runs, item).filter(F.col("n") >= F.floor(F.col("n_runs") / 2) + 1)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, precedence)), F.col(feature)), F.lit(0)), F.lit(999))
    kept = n.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(feature).alias("f")))), lambda x: x["f"]).alias("features"))
    out = items.select(item).join(runs, item, "left").join(kept, item, "left")
    return out.select(item, F.coalesce("features", F.array().cast("array<string>")).alias("features"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


def merge_answers(answers: DataFrame, item: str) -> DataFrame:
    """One answer an item out of its runs (run, parse_error, label, labels, coverage map, crack, crack_pct, subtypes map, notes map).

    Runs with a parse error do not count. The commonest label wins, the first seen of equals; labels are united and sorted;
    coverage is averaged over the runs that mention a label; the crack share over runs that say `yes` with a number, else
    null; subtype by majority (a run without one says `unknown`), the first note that is not empty. n_runs and n_total count runs.
    """
    good = answers.filter(~F.coalesce("parse_error", F.lit(False)))
    total = answers.groupBy(item).agg(F.count(F.lit(1)).alias("n_total"))
    base = good.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.bround(F.avg(F.when((F.lower("crack") == "yes") & F.col("crack_pct").isNotNull(), F.col("crack_pct")))).cast("int").alias("crack_pct"))
    label = good.filter("label is not null").groupBy(item, "label").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("at"))
    label = label.groupBy(item).agg(F.min_by("label", F.struct(-F.col("n"), "at")).alias("label"))
    cover = good.select(item, F.explode("coverage").alias("k", "v")).groupBy(item, "k").agg(F.bround(F.avg("v")).cast("int").alias("v"))
    cover = cover.groupBy(item).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("coverage"))
    every = base.select(item, F.explode("labels").alias("k")).join(good.select(item, "run", "subtypes", "notes"), item)
    sub = F.coalesce(F.try_element_at("subtypes", F.col("k")), F.lit("unknown"))
    votes = every.select(item, "k", "run", sub.alias("s"), F.nullif(F.try_element_at("notes", F.col("k")), F.lit("")).alias("note"))
    kind = votes.filter("s <> ''").groupBy(item, "k", "s").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("at")).groupBy(item, "k").agg(F.min_by("s", F.struct(-F.col("n"), "at")).alias("subtype"))
    note = votes.filter("note is not null").groupBy(item, "k").agg(F.min_by("note", "run").alias("note"))
    detail = kind.join(note, [item, "k"], "left").groupBy(item).agg(F.array_sort(F.collect_list(F.struct("k", "subtype", F.coalesce("note", F.lit("")).alias("note")))).alias("details"))
    return total.join(base, item, "left").join(label, item, "left").join(cover, item, "left").join(detail, item, "left")


def cell_majority(votes: DataFrame, cells: DataFrame, keys: list[str], label: str, order: str, vocabulary: list[str]) -> DataFrame:
    """keys and label of every cell: the commonest vote of the vocabulary, first seen of equals; null where excluded or without votes."""
    n = votes.filter(F.col(label).isin(vocabulary)).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    best = n.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("n"), "at")).alias("_l"))
    return cells.join(best, keys, "left").select(*keys, F.when(~F.coalesce("excluded", F.lit(False)), F.col("_l")).alias(label))


def census(faces: DataFrame, by: str) -> DataFrame:
    """by, classified, inferred, unlabelled: faces by where their label comes from."""
    known = F.col("label").isNotNull()
    guess = F.coalesce("inferred", F.lit(False))
    return faces.groupBy(by).agg(F.count_if(known & ~guess).alias("classified"), F.count_if(known & guess).alias("inferred"), F.count_if(~known).alias("unlabelled"))
