"""Tables in between, written where every executor can read them, and what is built on them."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the one the cluster shares (``spark.checkpoint.dir``); a folder of this machine will do only where all runs in one process."""
    if not spark.conf.get("spark.checkpoint.dir", ""):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="threatscan-"))
    return f"{spark.conf.get('spark.checkpoint.dir')}/threatscan-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back; ``drop_stored`` deletes all of them."""
    at = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that this application has stored. Results that still read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which null equals null; the columns are there once."""
    other = right.select(*(F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns))
    return left.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on)), how).drop(*(f"__{c}" for c in on))


def in_blocks(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``block`` and ``pos``, each row's number within its key, from 1; stored.

    Rows are dealt out by ranges of key and order, so that a key with a third of
    all rows lies in many blocks; within a key blocks follow each other in
    order. What has to be carried on from row to row goes through a window over
    (key, block) and another over one row for each block.
    """
    cut = stored(rows.repartitionByRange(key, *order).withColumn("block", F.spark_partition_id()))
    before = W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n")).select(key, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = cut.withColumn("__own", F.row_number().over(W.partitionBy(key, "block").orderBy(*order)))
    return stored(met(own, sizes, [key, "block"]).withColumn("pos", F.col("__before") + F.col("__own")).drop("__before", "__own"))


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of the nodes of ``edges (a, b)``, component the smallest id that can be reached.

    Rounds of large and small stars over stored tables; one count and one sum a
    round reach the driver.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        both = near.join(low, "u").filter(F.lit(small) | (F.col("v") > F.col("u"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if small:
            both = both.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return both.filter("a <> b").distinct()

    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, e = now, stored(star(star(e, False), True))
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
