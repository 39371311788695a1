"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``). Where it is unset, a temporary one if all runs in one process; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="threatscan-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/threatscan-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends here, on files every executor sees. ``drop_stored`` deletes them."""
    spark = df.sparkSession
    at = f"{own_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that this application has stored. Results that still read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound Arrow batches by bytes as well as rows, so long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a long, b long)`` as ``(id, component)``, component the smallest id.

    Alternating large-star / small-star rounds; each round ends in a stored
    table, so a lost executor replays one round. Nothing but one counter per
    round reaches the driver. Loops, repeated and reversed edges are allowed;
    an empty input gives an empty result.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = near.join(low, "u")
        if small:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(e)
    while True:
        e = stored(star(star(e, False), True))
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
