"""Graph operators as relational loops."""

from __future__ import annotations

import atexit
import tempfile
from contextlib import suppress
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; on one machine a temporary one where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="shardlake-"))
    return spark.sparkContext.getCheckpointDir()


def _sweep(spark: SparkSession, paths: set[str]) -> None:
    """Remove the tables that are left when the application ends: nothing can read them any more."""
    with suppress(Exception):  # the JVM may be gone
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def own(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the application ends."""
    path, sc = f"{folder(spark)}/{name}-{uuid4().hex}", spark.sparkContext
    if not hasattr(sc, "_shardlake_paths"):
        sc._shardlake_paths = set()
        atexit.register(_sweep, spark, sc._shardlake_paths)
    sc._shardlake_paths.add(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table in the shared checkpoint folder, whose size is that of its files (a checkpoint's estimate multiplies with every join)."""
    path = own(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        t.sparkSession.sparkContext._shardlake_paths.discard(t._cut_path)


def wide(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are dealt out and sorted by the keys. Its files' size says little of its rows, so it must not go through the driver."""
    return df.hint("merge")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), taken as undirected, by contraction.

    In a round every node hooks onto its smallest neighbour if that is smaller; edges and labels follow, and edges inside a
    part vanish. Hubs and large parts are hot keys of joins only, whose sides both read checkpoints: adaptive execution splits them.
    Null ends take no part; a loop makes a component of its own.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = cut(ordered(edges.filter("a is not null and b is not null")))
    found = cut(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    open_ = rest.filter("a <> b")
    while not open_.isEmpty():
        one = cut(open_.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to")))
        again = one.select(F.col("from").alias("f2"), F.col("to").alias("t2"))
        up = cut(one.join(again, F.col("to") == F.col("f2"), "left").select("from", F.coalesce("t2", "to").alias("to")))
        named = cut(found.join(up, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component")))
        moved = open_.join(up, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        moved = moved.join(up.select(F.col("from").alias("f2"), F.col("to").alias("t2")), F.col("b") == F.col("f2"), "left").select("a", F.coalesce("t2", "b").alias("b"))
        left = cut(ordered(moved.filter("a <> b")))
        drop(one, up, found, rest)
        found, rest = named, left
        open_ = rest
    drop(rest)
    return found
