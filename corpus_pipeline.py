"""The training-corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

All stages but the last return the columns of their input, whatever their
names: a column called like one that an operator adds passes untouched. Rows
are told apart by ``doc_id`` and text. Empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatscan.llm.common import own_dir, table
from threatscan.llm.decontaminate import decontaminated
from threatscan.llm.dedup_lines import dedup_lines
from threatscan.llm.packing import pack_documents
from threatscan.llm.quality import quality
from threatscan.llm.simhash import one_of_each


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, and all others inside one column ``row``, where no name can clash."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*rest) if rest else F.lit(None).cast("struct<none:int>")).alias("row"))


def _unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from what an operator made of ``_carried``."""
    row = out.schema["row"].dataType.names
    return out.select(*(F.col("row")[c].alias(c) if c in row else F.col(c) for c in docs.columns))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; null ``lang`` or ``source`` is a group of its own; equal rows are judged alike, and ties at a fence stay."""
    return _unpacked(quality(_carried(docs, "doc_id", "lang", "source", "text")).filter("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; ``n_chars`` follows the text.

    Every row stays, with a null text too, and one that is all repeats becomes
    empty. The first place of a chunk is that of the smallest ``doc_id``, then
    of the smallest hash of the text; rows without ``doc_id`` are left alone.
    """
    out = _unpacked(dedup_lines(_carried(docs, "doc_id", "text")), docs)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by SimHash links and by similarity: the smallest ``doc_id``, then the smallest hash of the text. Equal rows become one; rows without ``doc_id`` stay; null texts are alike."""
    return one_of_each(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null texts hold none; rows that share an id but not their text are judged each by itself."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequences and places; a null text is an empty one."""
    return pack_documents(docs)


STAGES = [("quality", rules), ("line_dedup", lines), ("simhash", near_duplicates), ("decontaminate", decontaminate), ("packing", packing)]

#: Sketch similarity and tokenizing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages. What the stages wrote lies in the application's folder, which ``drop_stored`` deletes."""
    at, docs = f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{name}")
    return docs
