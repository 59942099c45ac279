"""Reports on cached votes, as text or markdown: python -m shardlake.reports FOLDER [--markdown]. Exit 1 without complete batches."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlake.operators import evaluation
from shardlake.sources import records


def table(head: tuple, rows: list[tuple], markdown: bool = False) -> list[str]:
    """Lines of a table: columns as wide as their widest cell, or markdown. Nulls and empty cells read (none)."""
    said = [["(none)" if v is None or v == "" else f"{v:.0%}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    if markdown:
        line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
        return [line(head), line(["---"] * len(head)), *map(line, said)]
    wide = [max(len(c) for c in column) for column in zip(head, *said)]
    return ["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in (head, *said)]


def agreement(votes: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Rows of both tables, features with a line of all and combinations: as many as there are features and combinations."""
    by = ("batch", "region", "feature", "run")
    per = [tuple(r[c] for c in ("feature", "all3", "two", "one", "all3_share")) for r in evaluation.agreement(votes, *by).collect()]
    sums = [sum(r[k] for r in per) for k in (1, 2, 3)]
    per += [("all", *sums, sums[0] / sum(sums))] if sum(sums) else []
    return per, [(r["combination"], r["items"], r["share"]) for r in evaluation.combinations(votes, *by).collect()]


def main(args: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="shardlake.reports", description=__doc__)
    p.add_argument("folder")
    p.add_argument("--markdown", action="store_true")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("shardlake").getOrCreate()
    votes = records.read_votes(spark, a.folder)
    complete = evaluation.observed(votes, "batch", "region", "feature", "run")
    if complete.isEmpty():
        print("no batch with three runs", file=sys.stderr)
        return 1
    skipped = votes.select("batch").distinct().join(complete.select("batch").distinct(), "batch", "left_anti").agg(F.count(F.lit(1))).first()[0]
    per, sets = agreement(votes)
    print("\n".join([*table(("feature", "3/3", "2/3", "1/3", "unanimous"), per, a.markdown), "", *table(("combination", "regions", "share"), sets, a.markdown), "", f"{skipped} batch(es) without three runs set aside"]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
