"""Fill-in-middle transformation over seekable compressed frames.

A text is kept as independent zstandard frames of bounded size, each with the
number of the first unit (line) that starts in it, how many start there and how
many code points it holds. A cut after so many units is found in these running
counts; the one frame with the cut is decompressed for its place. Transformed
texts are streams of slices of frames in order, so that no step but the first
needs a whole text, and they are read back from their stream by their marks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatscan.llm.common import bound_batches, stored, table

#: Bytes of text in a frame.
FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_FRAMES = "array<struct<first:long,units:long,leads:boolean,chars:long,size:long,data:binary>>"


def frames_of(text: str, size: int = FRAME) -> list[dict]:
    """The frames of a text, cut between code points; a frame ``leads`` if a unit starts at its first byte."""
    raw, pack = text.encode(), zstandard.ZstdCompressor()
    out, at, first = [], 0, 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        part = raw[at:end]
        leads = at == 0 or raw[at - 1] == 10
        units = leads + part.count(b"\n", 0, len(part) - 1)
        out.append({"first": first, "units": units, "leads": leads, "chars": len(part.decode()), "size": len(part), "data": pack.compress(part)})
        at, first = end, first + units
    return out


class Frames:
    """A stored text: places of units, and streams of its bytes. A place is a frame, an offset in it, and the code points before it."""

    def __init__(self, frames) -> None:
        self.frames = list(frames)
        self.firsts = [f["first"] for f in self.frames]
        self.before = np.cumsum([0, *(f["chars"] for f in self.frames)]).tolist()
        self.n = self.firsts[-1] + self.frames[-1]["units"] if self.frames else 0
        self.end = (len(self.frames), 0, self.before[-1])
        self._unpack = zstandard.ZstdDecompressor()

    def bytes_of(self, i: int) -> bytes:
        return self._unpack.decompress(self.frames[i]["data"], max_output_size=self.frames[i]["size"])

    def place(self, unit: int) -> tuple[int, int, int]:
        """Where a unit starts; the text's end for the number of units."""
        if unit >= self.n:
            return self.end
        i = bisect_right(self.firsts, unit) - 1
        k, leads, part = unit - self.firsts[i], self.frames[i]["leads"], self.bytes_of(i)
        offset = 0 if leads and not k else int(np.flatnonzero(np.frombuffer(part, np.uint8) == 10)[k - leads]) + 1
        return i, offset, self.before[i] + len(part[:offset].decode())

    def stream(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[bytes]:
        """The bytes between two places, frame by frame."""
        for i in range(start[0], min(end[0] + (end[1] > 0), len(self.frames))):
            part = self.bytes_of(i)
            yield part[start[1] if i == start[0] else 0 : end[1] if i == end[0] else len(part)]


def output(text: Frames, form: str, one: tuple, two: tuple) -> Iterator[bytes]:
    """The transformed text, cut at two places."""
    start = (0, 0, 0)
    if form == "plain":
        yield from text.stream(start, text.end)
        return
    prefix = lambda: text.stream(start, one)
    suffix = lambda: text.stream(two, text.end)
    for mark, part in ((PREFIX, prefix), (SUFFIX, suffix)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix)):
        yield mark
        yield from part()
    yield MIDDLE
    yield from text.stream(one, two)


def _find(stream: Iterator[bytes], marks: list[bytes]) -> list[int]:
    """Where the marks stand in a stream, each sought behind the one before it."""
    found, held, at, marks = [], b"", 0, list(marks)
    for part in stream:
        held += part
        i = 0
        while marks and (i := held.find(marks[0], i)) >= 0:
            found.append(at + i)
            i += len(marks.pop(0))
        cut = max(len(held) - 2, 0)
        if found:
            cut = max(cut, min(found[-1] + 3 - at, len(held)))
        held, at = held[cut:], at + cut
    return found


def _between(stream: Iterator[bytes], start: int, end: int | None) -> Iterator[bytes]:
    at = 0
    for part in stream:
        lo, hi = max(start - at, 0), len(part) if end is None else min(end - at, len(part))
        if lo < hi:
            yield part[lo:hi]
        at += len(part)
        if end is not None and at >= end:
            return


def restored(out: Callable[[], Iterator[bytes]], form: str) -> Iterator[bytes]:
    """The text before the transformation, from its output and form alone; ``out`` starts the output's stream anew."""
    if form == "plain":
        yield from out()
        return
    _, second, third = _find(out(), [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE])
    early, late = (3, second), (second + 3, third)
    prefix, suffix = (early, late) if form == "psm" else (late, early)
    for start, end in (prefix, (third + 3, None), suffix):
        yield from _between(out(), start, end)


def _digest(stream: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for part in stream:
        h.update(part)
    return h.hexdigest()


def frame_store(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """``docs (doc_id, text)`` as ``doc_id, frames, marked``, stored; ``marked`` texts hold one of the marks themselves. Null texts are empty and have no frame."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(_FRAMES)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([frames_of(t, size) for t in texts])

    text = F.coalesce("text", F.lit(""))
    marked = text.contains(PREFIX.decode()) | text.contains(SUFFIX.decode()) | text.contains(MIDDLE.decode())
    return stored(docs.select("doc_id", cut(text).alias("frames"), marked.alias("marked")))


def cuts(store: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``store`` with the number of units ``n``, the ``form``, and the units before the first and the second cut, drawn from the SHA-256 of seed and ``doc_id``."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(told, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    last = F.try_element_at("frames", F.lit(-1))
    out = store.withColumn("n", F.coalesce(last["first"] + last["units"], F.lit(0).cast("long")))
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return out.select("doc_id", "n", form.alias("form"), F.least(one, two).alias("one"), F.greatest(one, two).alias("two"), "frames")


def fill_in_middle(docs: DataFrame, **draw) -> DataFrame:
    """``docs (doc_id, text)`` as ``doc_id, n, form, output``; ``draw`` goes to ``cuts``.

    Null and empty texts are plain and stay empty, texts that hold a mark are
    plain as they are. A null ``doc_id`` draws as an empty one. Rows of one id
    are transformed alike, each on its own. Texts are whole whatever their
    length. Other columns are not read. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def written(frames: pd.Series, form: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for f, kind, a, b in zip(frames, form, one, two, strict=True):
            text = Frames(f)
            out.append(b"".join(output(text, kind, text.place(a), text.place(b))).decode())
        return pd.Series(out)

    return cuts(frame_store(docs), **draw).select("doc_id", "n", "form", written("frames", "form", "one", "two").alias("output"))


def digests(docs: DataFrame, **draw) -> DataFrame:
    """What ``fill_in_middle`` makes, as sizes and digests of output and restored text; both go through the hash frame by frame."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    def told(frames: pd.Series, form: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for f, kind, a, b in zip(frames, form, one, two, strict=True):
            text = Frames(f)
            p, q = text.place(a), text.place(b)
            made = lambda text=text, kind=kind, p=p, q=q: output(text, kind, p, q)
            rows.append((p[2], q[2] - p[2], _digest(made()), _digest(restored(made, kind))))
        return pd.DataFrame(rows, columns=["prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    out = cuts(frame_store(docs), **draw).select("doc_id", "n", "form", told("frames", "form", "one", "two").alias("d"))
    chars = lambda c: F.when(F.col("form") != "plain", F.col(f"d.{c}")).alias(c)
    return out.select("doc_id", "n", "form", chars("prefix_chars"), chars("middle_chars"), "d.output_sha256", "d.restored_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', doc_id)) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, l, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS y, array_to_string(l[b + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', x, '<S>', z, '<M>', y) ELSE concat('<S>', z, '<P>', x, '<M>', y) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

QUERIES = {"op12_middle": (op12, SQL)}
