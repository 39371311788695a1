"""Line dedup by content-defined chunks of lines.

A text is a list of lines. A rolling hash over the hashes of neighbouring lines
marks chunk ends, so the same run of lines is cut alike wherever it stands and
an insertion moves only the chunks around it; a chunk holds two lines at least.
Where a repeated passage begins or ends inside a chunk, its rim lines share a
chunk with the host's own lines. So there are runs beside the chunks that reach
over their ends: from each line on, and up to each line, the shortest run of
``passage`` words or more. A chunk, or such a run, that stands at an earlier place anywhere in the corpus
is removed; its first place (smallest ``doc_id``, then text, then line) stays.

Chunks meet by hashes of their line hashes. Before anything is removed, the
bytes behind all hashes that repeat are compared; if two different lines, or
runs, ever share a hash, the whole pass is repeated with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from threatscan.llm.common import bound_batches, fresh, stored, table

#: A chunk of two lines or more ends after one line in so many.
EVERY = 2
#: A run of lines with so many words goes if it repeats, wherever chunks end.
PASSAGE = 50
#: Neighbouring line hashes under the rolling hash, and its base.
_ROLL, _BASE = 2, np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(hashes: np.ndarray, every: int) -> list[int]:
    """The line after each chunk: where the rolling hash says so and two lines are in it, and the end of the text."""
    rolled = hashes.copy()
    for back in range(1, min(_ROLL, len(hashes))):
        rolled[back:] += hashes[:-back] * _BASE**back
    mixed = (rolled ^ (rolled >> np.uint64(29))) * _BASE >> np.uint64(33)
    ends, since = [], 0
    for i in (np.flatnonzero(mixed % np.uint64(every) == 0) + 1).tolist():
        if i - since >= 2:
            ends.append(i)
            since = i
    if since < len(hashes):
        ends.append(len(hashes))
    return ends


def runs(lines: list[bytes], hashes: np.ndarray, every: int, passage: int) -> list[tuple[int, int]]:
    """``(first, end)`` of the chunks and of the runs of ``passage`` words; none without any word."""
    upto = np.cumsum([0, *(len(x.split()) for x in lines)])
    out, since = set(), 0
    for end in chunk_ends(hashes, every):
        if end - since >= 2 and upto[end] > upto[since]:
            out.add((since, end))
        since = end
    rims = np.flatnonzero(np.diff(upto) > 0)
    ends = np.searchsorted(upto, upto[rims] + passage)
    out.update((a, b) for a, b in zip(rims.tolist(), ends.tolist(), strict=True) if b <= len(lines))
    starts = np.searchsorted(upto, upto[rims + 1] - passage, side="right") - 1
    out.update((a, b + 1) for a, b in zip(starts.tolist(), rims.tolist(), strict=True) if a >= 0)
    return sorted(out)


def line_hashes(lines: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in lines), dtype=np.uint64, count=len(lines))


def _units(docs: DataFrame, every: int, passage: int, seed: int) -> DataFrame:
    """``(doc_id, tk, first, end, h)``: the chunks and runs of each text and the hash of their line hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, end, h = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines = text.encode().split(b"\n")
                hashes = line_hashes(lines, seed)
                raw = hashes.tobytes()
                for a, b in runs(lines, hashes, every, passage):
                    row.append(i)
                    first.append(a)
                    end.append(b)
                    h.append(xxhash.xxh64_intdigest(raw[8 * a : 8 * b], seed))
            at = pa.array(row, pa.int64())
            hs = pa.array(np.array(h, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(end, pa.int32()), hs], ["doc_id", "tk", "first", "end", "h"])

    schema = StructType([docs.schema["doc_id"], StructField("tk", LongType()), StructField("first", IntegerType()), StructField("end", IntegerType()), StructField("h", LongType())])
    return docs.select("doc_id", "tk", "text").mapInArrow(cut, schema)


def _evidence(met: DataFrame, seed: int) -> DataFrame:
    """``(of, h, bytes)`` of ``met (text, units)``: each line in a unit and each unit's line hashes, behind their hashes; equal rows of a batch once."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = text.encode().split(b"\n")
                hashes = line_hashes(lines, seed)
                raw, own = hashes.tobytes(), hashes.view(np.int64).tolist()
                for u in units:
                    a, b = u["first"], u["end"]
                    seen.add((1, u["h"], raw[8 * a : 8 * b]))
                    seen.update((0, own[i], lines[i]) for i in range(a, b))
            of, h, what = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(h, pa.int64()), pa.array(what, pa.binary())], ["of", "h", "bytes"])

    return met.select("text", "units").mapInArrow(show, StructType([StructField("of", IntegerType()), StructField("h", LongType()), StructField("bytes", BinaryType())]))


def repeated_runs(docs: DataFrame, every: int = EVERY, passage: int = PASSAGE, seed: int = 0) -> DataFrame:
    """``(doc_id, tk, first, end)`` of every later place of a repeated chunk or run of ``docs (doc_id, tk, text)``.

    Hashes alone are dealt out; a hash that all rows share is summed in each
    task first, and the tables that hot hashes are joined with are stored, so
    that Spark can split the hot side.
    """
    bound_batches(docs.sparkSession)
    units = stored(_units(docs, every, passage, seed))
    again = stored(units.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    cand = stored(units.join(again, "h", "left_semi"))
    first = stored(cand.groupBy("h").agg(F.min(F.struct("doc_id", "tk", "first")).alias("place")).select(F.col("h").alias("__h"), "place"))
    here = F.struct("doc_id", "tk", "first")
    more = stored(cand.join(first, F.col("h") == F.col("__h")).filter(here != F.col("place")).select("doc_id", "tk", "first", "end", "h"))
    places = cand.join(stored(more.select("h").distinct()), "h", "left_semi")
    own = places.groupBy(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).agg(F.collect_set(F.struct("first", "end", "h")).alias("units"))
    met = docs.join(own, (docs["doc_id"] == F.col("__id")) & (docs["tk"] == F.col("__tk"))).select("text", "units")
    clash = _evidence(met, seed).distinct().groupBy("of", "h").count().filter("count > 1")
    if not clash.isEmpty():
        return repeated_runs(docs, every, passage, seed + 1)
    return more.select("doc_id", "tk", "first", "end")


def _without(text: Column, spans: Column) -> Column:
    """``(text, lines_removed)`` of texts without the lines of their spans; null without spans."""

    @F.pandas_udf("text string, lines_removed long")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out, gone = [], []
        for t, own in zip(texts, spans, strict=True):
            if t is None:
                out.append(None)
                gone.append(0)
                continue
            lines = t.split("\n")
            keep = np.ones(len(lines), dtype=bool)
            for s in own:
                keep[s["first"] : s["end"]] = False
            out.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k))
            gone.append(int((~keep).sum()))
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "lines_removed": gone})

    return cut(F.when(spans.isNotNull(), text), spans)


def dedup_lines(docs: DataFrame, every: int = EVERY, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, plus ``lines_removed`` (long).

    Null text stays null and empty text empty. A text that is all repeats
    becomes empty; its row stays. Rows without ``doc_id`` are left alone. Rows
    that share a ``doc_id`` but not their text are places of their own; rows
    equal in both are one place and get equal texts. Blank lines alone are no
    chunk. Other columns pass through, whatever their names; ``lines_removed``
    gives way to the new one.
    """
    tk, spans, cut = (fresh(docs, n) for n in ("tk", "__spans", "__cut"))
    docs = docs.withColumn(tk, F.xxhash64("text"))
    known = docs.filter("text is not null and doc_id is not null").select("doc_id", F.col(tk).alias("tk"), "text")
    gone = repeated_runs(known, every, passage).groupBy(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).agg(F.collect_set(F.struct("first", "end")).alias(spans))
    met = docs.join(gone, (docs["doc_id"] == F.col("__id")) & (docs[tk] == F.col("__tk")), "left")
    lost = F.col(spans).isNotNull()
    met = met.select(*(docs[c] for c in docs.columns), spans, _without(docs["text"], F.col(spans)).alias(cut))
    left = F.when(lost, F.col(cut)["text"]).otherwise(F.col("text"))
    return met.select(*(left.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("lines_removed", tk)), F.coalesce(F.col(cut)["lines_removed"], F.lit(0)).cast("long").alias("lines_removed"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), "lines_removed", F.length("text").cast("long").alias("n_chars"), "text")


QUERIES = {"op4_line_dedup": (op4, None)}
