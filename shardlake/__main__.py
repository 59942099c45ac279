"""Command line of the record queries: python -m shardlake FOLDER [--use U] [--label L] ... Exit 1 without records, 2 for unsupported queries."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from shardlake.operators import design, query
from shardlake.sources import config, records

NUMBERS = ("min_face_area", "max_face_rms", "min_mass", "max_mass", "min_thickness", "max_thickness")
WORDS = ("use", "label", "anomaly", "handling", "connection", "assignment", "drill_zone")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shardlake", description=__doc__)
    p.add_argument("folder")
    p.add_argument("--glob", default="*_geometry.json")
    p.add_argument("--rules", help="rule file, for --geometry-only")
    for name in WORDS:
        p.add_argument(f"--{name.replace('_', '-')}")
    for name in NUMBERS:
        p.add_argument(f"--{name.replace('_', '-')}", type=float)
    p.add_argument("--reliable-only", action="store_true")
    p.add_argument("--geometry-only", action="store_true")
    p.add_argument("--list-uses", action="store_true")
    p.add_argument("--rank", dest="rank_by")
    p.add_argument("--top", dest="top_k", type=int)
    return p


def lines(found: DataFrame) -> list[str]:
    """One line a record: id, dimensions, mass and why it was found."""
    rows = found.select("fragment_id", "bounding.obb_dims_mm", "bounding.mass_kg_est", "why").collect()
    out = [f"{r[0]:<20} {' x '.join(f'{d:.0f}' for d in r[1] or []):<20} {'-' if r[2] is None else f'{r[2]:.1f} kg':>12}  {r[3]}" for r in rows]
    return [*out, f"{len(rows)} record(s)"] if rows else ["(none)"]


def main(args: list[str], spark: SparkSession | None = None) -> int:
    a = vars(parser().parse_args(args))
    spark = spark or SparkSession.builder.appName("shardlake").getOrCreate()
    for name in records.unreadable(spark, a["folder"], a["glob"]):
        print(f"skipping unreadable record: {name}", file=sys.stderr)
    found = records.read_records(spark, a["folder"], a["glob"])
    if found.isEmpty():
        print("no records", file=sys.stderr)
        return 1
    if a["geometry_only"]:
        rules = config.read_rules(spark, a["rules"]) if a["rules"] else {}
        if not rules:
            print("--geometry-only needs --rules", file=sys.stderr)
            return 2
        found = design.geometry_only(found, rules)
    if a["list_uses"]:
        print("\n".join(f"{r[0]:<20} {r[1]}" for r in query.list_uses(found).collect()))
        return 0
    try:
        if a["use"]:
            query.require_use(found, a["use"])
        print("\n".join(lines(query.select(found, reliable_only=a["reliable_only"], rank_by=a["rank_by"], top_k=a["top_k"], **{n: a[n] for n in WORDS + NUMBERS}))))
    except query.UnsupportedQuery as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
