"""Helpers shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
from functools import wraps
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and the rest, as the operators' contracts define words.
SPACE_WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, so that lost executors cost no recomputation."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="shardlake-"))  # one machine: its own folder is shared


def kept(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    For loops: unlike a checkpoint, whose size estimates are those of its plan and multiply with every join, a table has the size of its files.
    """
    spark = df.sparkSession
    _folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of `kept` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._kept)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of the edges (a, b) reaches, by contraction.

    Each round, every vertex hooks onto its smallest neighbour if that is smaller, and edges and labels are renamed; edges inside
    a part vanish. Joins on a hub or a large part's label read tables on both sides, so adaptive execution can split them.
    Null ends take no part; a loop makes a part of its own; without edges there is no row.
    """
    live = kept(edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label = kept(live.select(F.col("a").alias("v")).union(live.select("b")).distinct().select("v", F.col("v").alias("c")))
    while not live.filter("a <> b").isEmpty():
        first = kept(live.filter("a <> b").groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")))
        jump = first.join(first.select(F.col("x").alias("x2"), F.col("y").alias("y2")), F.col("y") == F.col("x2"), "left")
        hook = kept(jump.select("x", F.coalesce("y2", "y").alias("y")))
        named = kept(label.join(hook, F.col("c") == F.col("x"), "left").select("v", F.coalesce("y", "c").alias("c")))
        near = live.filter("a <> b").join(hook, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        far = hook.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
        near = near.join(far, F.col("b") == F.col("x2"), "left").select("a", F.coalesce("y2", "b").alias("b")).filter("a <> b")
        rest = kept(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        release(first, hook, label, live)
        label, live = named, rest
    release(live)
    return label


def carried(*needs: str):
    """For operators that add columns to whole rows: the caller's other columns travel as one struct, so that no name of theirs meets one of the operator's own.

    Columns that the operator makes replace those of the same name and stand last; the others keep their order.
    """

    def wrap(f):
        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in needs]
            lean = docs.select(*[c for c in needs if c in docs.columns], *([F.struct(*rest).alias("_carried")] if rest else []))
            out = f(lean, *args, **kwargs)
            new = [c for c in out.columns if c not in needs and c != "_carried"]
            kept = [F.col(c) if c in needs else F.col(f"_carried.`{c}`").alias(c) for c in docs.columns if c not in new]
            return out.select(*kept, *new)

        return run

    return wrap


def ship(df: DataFrame) -> None:
    """Send the package to the executors, once a context: they need not have it installed."""
    sc = df.sparkSession.sparkContext
    if getattr(sc, "_shardlake_shipped", None) is None:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="shardlake-")  # the driver's own; Spark's file server hands it out
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        sc._shardlake_shipped = True


def held_out(doc_id: Column) -> Column:
    """Fold of a document: null ids fall in the fold of the text `null`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 5 == 0


def ascii_lower(text: str) -> str:
    return text.translate(_LOWERING)


_LOWERING = str.maketrans(UPPER, LOWER)
