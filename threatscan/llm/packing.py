"""Best-fit packing of token pieces by exact complements.

Only the number of pieces of each length matters for the plan, so it is made
from a histogram of at most ``capacity`` rows: for the longest length left, look
up a single length, a pair, or a triple that fills the gap exactly, and use it
as often as the counts allow; where there is none, put in the longest length
that fits and look again. The plan is a table of rank ranges of each length;
pieces get ranks in Spark and meet their range in a broadcast join of at most
``capacity`` rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from threatscan.llm.common import bound_batches, stored, table

CAPACITY = 1024
END = 2
#: Ranks within a length are counted in so many parts, so that a length that half of all pieces have is no single group.
PARTS = 1024


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others after 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(path: str):
    """``text -> ids`` of a vocabulary file of ``tokenizers``; strings of its special tokens are ordinary text.

    A byte-level vocabulary numbers its tokens in the order of its merges. Then
    the numbers are all that merging needs, and ``tiktoken`` merges by them: the
    same ids (tests hold them against ``tokenizers``), in a third of the time
    and without remembering words. Any other vocabulary goes through
    ``tokenizers``.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, letters = said["model"], _byte_letters()
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges") or ()]
    plain = all(not said.get(k) for k in ("normalizer", "post_processor")) and (said.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and model["type"] == "BPE" and all(model["vocab"][m] == 256 + i for i, m in enumerate(merges)):
        import tiktoken

        special = {t["content"] for t in said["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


_ENCODERS: dict = {}


def token_ids(text: str | None, path: str) -> bytes:
    """The text's ids as little-endian uint32, end token last."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _encoder(path)
    return np.array([*_ENCODERS[path](text or ""), END], dtype="<u4").tobytes()


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and, if asked for, ``ids`` (binary, little-endian uint32).

    A text of over ``capacity`` tokens is cut from its end, so only its first
    piece may be shorter. Null text is empty: its one piece is the end token.
    ``doc_id`` may be of any type and passes through unchanged, null too.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    bound_batches(docs.sparkSession, "8m")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                t = token_ids(text, path)
                n = len(t) // 4
                at, size = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    part = t[4 * at : 4 * (at + size)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if ids:
                        own.append(part)
                    at, size = at + size, capacity
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * ids, names + ["ids"] * ids)

    fields = [docs.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    return docs.select("doc_id", "text").mapInArrow(cut, StructType(fields + [StructField("ids", BinaryType())] * ids))


def _fill(gap: int, left: np.ndarray, most: int) -> list[int] | None:
    """One, two or three lengths in stock, ``most`` at most, that add up to ``gap``."""
    if left[gap] > 0:
        return [gap]
    if most == 1:
        return None
    have = (left > 0).astype(np.int64)
    pairs = np.convolve(have[: gap + 1], have[: gap + 1])[: gap + 1]

    def pair(total: int, taken: tuple = ()) -> list[int] | None:
        for a in range(total - 1, (total - 1) // 2, -1):
            b = total - a
            if have[a] and have[b] and left[a] > taken.count(a) + (a == b) and left[b] > taken.count(b) + (a == b):
                return [a, b]
        return None

    if pairs[gap] and (found := pair(gap)):
        return found
    for a in range(gap - 2, 0, -1) if most > 2 else ():
        if have[a] and pairs[gap - a] and (found := pair(gap - a, (a,))):
            return [a, *found]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """``(lengths, times)`` of each kind of sequence; every piece is used once.

    Triples taken early can use up the short lengths that later gaps need, so
    the plans with triples, with pairs at most and with singles are compared.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[list[int], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    for length in range(capacity, 0, -1):
        while left[length]:
            kind, gap = [length], capacity - length
            left[length] -= 1
            while gap:
                found = _fill(gap, left, most)
                if not found:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    found = [int(fits[-1])]
                for x in found:
                    left[x] -= 1
                kind += found
                gap -= sum(found)
            used = {x: kind.count(x) for x in kind}
            more = min(int(left[x]) // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= more * n
            out.append((kind, 1 + more))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut (doc_id, piece, length, ...)`` with ``sequence_id`` and ``offset``.

    The input is read twice, so give a stored table. Rows that are equal in
    every column take either one's place. An empty input gives an empty result.
    """
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # one row for each length: at most ``capacity``
    slots: dict[int, list] = {n: [] for n in counts}
    seen, first = dict.fromkeys(counts, 0), 0
    for kind, times in plan(counts, capacity):
        at = 0
        for n in kind:
            slots[n].append((seen[n], seen[n] + times, first, at))
            seen[n] += times
            at += n
        first += times
    ranges = spark.createDataFrame([(n, s) for n, s in slots.items()], "length long, slots array<struct<since:long,upto:long,first:long,at:long>>")

    parted = cut.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int"))
    sizes = parted.groupBy("length", "__part").count()
    before = sizes.select("length", "__part", (F.sum("count").over(W.partitionBy("length").orderBy("__part")) - F.col("count")).alias("__before"))
    ranked = parted.withColumn("__rank", F.row_number().over(W.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "__part"])
    placed = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).join(F.broadcast(ranges), "length")
    slot = F.filter("slots", lambda s: (s["since"] <= F.col("__rank")) & (F.col("__rank") < s["upto"]))[0]
    return placed.withColumn("__slot", slot).select(*cut.columns, (F.col("__slot.first") + F.col("__rank") - F.col("__slot.since")).alias("sequence_id"), F.col("__slot.at").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Each piece of ``docs (doc_id, text)`` with its sequence and place.

    Null and empty texts are one end token. Repeated rows are packed each.
    ``doc_id`` may be of any orderable type, and null. Other columns are not
    read. An empty table gives an empty result.
    """
    return pack(stored(pieces(docs, capacity, path)), capacity)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": (op7, None)}
