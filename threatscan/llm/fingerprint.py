"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for four primes, the polynomial hash of each of
its prefixes. From it follow the hash of any span in one step, equality of any
two spans, the longest common extension of two places by binary search, and
the array of a text that is put together from spans of others. The fingerprint
is the length and the hashes of the whole text. The likeness of two texts is
the share of their code points inside common spans: blocks of one are looked up
among all spans of the other and extended both ways.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from threatscan.llm.common import bound_batches, stored, table

#: The four largest primes below 2^31, and a base for each, larger than any code point.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003639, 1357924681, 1618033989, 1732050823)
#: How many of them tell spans apart (62 bits); the fingerprint has all.
SPAN_HASHES = 2
#: Code points of the blocks by which common spans are found; shorter ones count only at the texts' ends.
SPAN = 32

_powers: list[np.ndarray] = []


def _mod(x: np.ndarray, m: int) -> np.ndarray:
    return x - x // np.uint64(m) * np.uint64(m)


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers, or more, of each base; grown by doubling."""
    if _powers and len(_powers[-1]) >= n:
        return _powers
    if not _powers:
        _powers.extend(np.ones(1, np.uint64) for _ in PRIMES)
    for i, (m, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        while len(_powers[i]) < n:
            _powers[i] = np.concatenate([_powers[i], _mod(_powers[i] * np.uint64(pow(b, len(_powers[i]), m)), m)])
    return _powers


class Prefixes:
    """The prefix arrays of a text of ``n`` code points."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.arrays, self.n = arrays, len(arrays[0]) - 1
        self._spans: np.ndarray | None = None

    @classmethod
    def of(cls, text: str) -> Prefixes:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        arrays = []
        for p, m in zip(powers(len(codes)), PRIMES, strict=True):
            out = np.zeros(len(codes) + 1, np.uint32)
            out[1:] = _mod(np.cumsum(_mod(codes * p[: len(codes)], m)), m)
            arrays.append(out)
        return cls(arrays)

    def spliced(self, keep: int, other: Prefixes, take: int) -> Prefixes:
        """The arrays of this text's first ``keep`` code points followed by the first ``take`` of another, without either text."""
        arrays = []
        for a, b, p, m in zip(self.arrays, other.arrays, powers(keep + 1), PRIMES, strict=True):
            tail = _mod(b[1 : take + 1].astype(np.uint64) * p[keep] + np.uint64(a[keep]), m)
            arrays.append(np.concatenate([a[: keep + 1], tail.astype(np.uint32)]))
        return Prefixes(arrays)

    def fingerprint(self) -> str:
        """The length and the hashes of the whole, 8 hex digits each."""
        return f"{self.n:08x}" + "".join(f"{int(a[-1]):08x}" for a in self.arrays)

    def _raw(self, which: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        a, m = self.arrays[which], PRIMES[which]
        d = a[at + length].astype(np.int64) - a[at]
        return np.where(d < 0, d + m, d).astype(np.uint64)

    def equal(self, at: np.ndarray, other: Prefixes, there: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether spans of this text equal spans of another."""
        out = np.ones(len(at), bool)
        for k, p in enumerate(powers(max(self.n, other.n) + 1)[:SPAN_HASHES]):
            out &= _mod(self._raw(k, at, length) * p[there], PRIMES[k]) == _mod(other._raw(k, there, length) * p[at], PRIMES[k])
        return out

    def extension(self, at: np.ndarray, other: Prefixes, there: np.ndarray, back: bool = False) -> np.ndarray:
        """Lengths of the longest common extensions behind (or before) two places each, by binary search."""
        low, high = np.zeros(len(at), np.int64), np.minimum(at, there) if back else np.minimum(self.n - at, other.n - there)
        high = high.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(at - mid, other, there - mid, mid) if back else self.equal(at, other, there, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def common(self, at: int, other: Prefixes, there: int, back: bool = False) -> int:
        """``extension`` of one pair of places."""
        low, high = 0, min(at, there) if back else min(self.n - at, other.n - there)
        tables = [(a, b, p, m) for a, b, p, m in zip(self.arrays, other.arrays, powers(max(self.n, other.n) + 1), PRIMES[:SPAN_HASHES], strict=False)]
        while low < high:
            n = (low + high + 1) // 2
            i, j = (at - n, there - n) if back else (at, there)
            if all((int(a[i + n]) - int(a[i])) * int(p[j]) % m == (int(b[j + n]) - int(b[j])) * int(p[i]) % m for a, b, p, m in tables):
                low = n
            else:
                high = n - 1
        return low

    def spans(self, start: int = 0, end: int | None = None, step: int = 1) -> np.ndarray:
        """Hashes of the spans of ``SPAN`` code points that start at every ``step``-th place from ``start``, before ``end``; the same wherever a span lies."""
        end = max(self.n - SPAN + 1, 0) if end is None else end
        if step == 1 and self._spans is not None:
            return self._spans
        out = np.zeros(len(range(start, end, step)), np.uint64)
        for k, a in enumerate(self.arrays[:SPAN_HASHES]):
            m = PRIMES[k]
            d = a[start + SPAN : end + SPAN : step].astype(np.int64) - a[start:end:step]
            d += (d < 0) * np.int64(m)
            out = (out << np.uint64(31)) | _mod(d.astype(np.uint64) * _inverses(k, self.n + 1)[start:end:step], m)
        if step == 1:
            self._spans = out
        return out


_inverse: dict[int, np.ndarray] = {}


def _inverses(k: int, n: int) -> np.ndarray:
    """Powers of a base's inverse."""
    out, back = _inverse.get(k, np.ones(1, np.uint64)), pow(BASES[k], -1, PRIMES[k])
    while len(out) < n:
        out = np.concatenate([out, _mod(out * np.uint64(pow(back, len(out), PRIMES[k])), PRIMES[k])])
    _inverse[k] = out
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray) -> int:
    """Places inside any of the spans."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], (starts + lengths)[order]
    reach = np.concatenate([[0], np.maximum.accumulate(e)[:-1]])
    return int(np.maximum(e - np.maximum(s, reach), 0).sum())


def likeness(a: Prefixes, b: Prefixes) -> float:
    """The share of the code points of two texts that lie inside common spans, 0 to 1; equal texts have 1, also empty ones."""
    if a.n == b.n and a.fingerprint() == b.fingerprint():
        return 1.0
    if not a.n or not b.n:
        return 0.0
    head = a.common(0, b, 0)
    tail = a.common(a.n, b, b.n, back=True)
    at, there, length = [[0, a.n - tail]], [[0, b.n - tail]], [[head, tail]]
    # blocks inside the common ends need no search
    start, end = (max(head - SPAN, -1) // SPAN + 1) * SPAN, min(b.n - SPAN + 1, b.n - tail)
    if a.n >= SPAN and start < end:
        sought = b.spans(start, end, SPAN)
        order = np.argsort(sought, kind="stable")
        known, windows = sought[order], a.spans()
        i = np.minimum(np.searchsorted(known, windows), len(known) - 1)
        hit = np.flatnonzero(known[i] == windows)
        if len(hit):
            # every block at its first place in the other text; of equal blocks the first
            which, first = np.unique(i[hit], return_index=True)
            x, y = hit[first], start + SPAN * order[which]
            before, behind = a.extension(x, b, y, back=True), a.extension(x, b, y)
            at.append(x - before)
            there.append(y - before)
            length.append(before + behind)
            # blocks that repeat within this text lie inside common spans too
            same = np.searchsorted(known, known)
            again = np.flatnonzero((same != np.arange(len(known))) & np.isin(same, which))
            if len(again):
                x, y = hit[first][np.searchsorted(which, same[again])], start + SPAN * order[again]
                before, behind = a.extension(x, b, y, back=True), a.extension(x, b, y)
                at.append(x - before)
                there.append(y - before)
                length.append(before + behind)
    at, there, length = (np.concatenate([np.asarray(v, np.int64) for v in x]) for x in (at, there, length))
    return (_covered(at, length) + _covered(there, length)) / (a.n + b.n)


def _edited(text: str, following: str) -> tuple[str, int, int]:
    cut = len(text) // 3
    keep = len(text) - cut
    return text[:keep] + following[:cut], keep, min(cut, len(following))


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _told(text: str, own: Prefixes, following: str, other: Prefixes) -> tuple:
    """What is returned for a text and the one that follows it."""
    edited, keep, take = _edited(text, following)
    put = own.spliced(keep, other, take)
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.fingerprint(), put.fingerprint(), likeness(own, put), likeness(own, other)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` as ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the one with the next smaller ``doc_id``, after the
    smallest the largest; null ids come last, rows of one id by a hash of their
    text. In a table of one row that row follows itself. Null texts are empty.
    Other columns are not read. An empty table gives an empty result. The
    documents are dealt out by ranges, equal rows too, and each meets the next
    one within its range; the last of a range meets the first of the next range
    in a second step, of one pair of texts a range. A task holds two texts and
    their arrays, some 60 bytes a code point.
    """
    bound_batches(docs.sparkSession)
    kinds = f"no_id boolean, id long, part int, edge string, text string, {_OUT}"
    names = ["no_id", "id", "part", "edge", "text", *_NAMES]

    def walk(batches):
        part, last, out = TaskContext.get().partitionId(), None, []
        for pdf in batches:
            for no_id, i, text in zip(pdf["no_id"], pdf["id"], pdf["text"], strict=True):
                own = Prefixes.of(text)
                if last is None:
                    out.append((no_id, i, part, "first", text, *[None] * 6))
                else:
                    out.append((*last[:2], part, None, None, *_told(last[2], last[3], text, own)))
                last = (no_id, i, text, own)
            yield pd.DataFrame(out, columns=names)
            out = []
        if last is not None:
            yield pd.DataFrame([(*last[:2], part, "last", last[2], *[None] * 6)], columns=names)

    def meet(batches):
        for pdf in batches:
            rows = [(*r[:2], *_told(r[2], Prefixes.of(r[2]), r[3], Prefixes.of(r[3]))) for r in zip(pdf["no_id"], pdf["id"], pdf["text"], pdf["following"], strict=True)]
            yield pd.DataFrame(rows, columns=["no_id", "id", *_NAMES])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("no_id"), F.col("id").desc(), F.col("hash"), F.col("row")]
    marks = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("no_id", "id", "text").mapInPandas(walk, kinds))
    rims = marks.filter("edge is not null")
    # numbers of the ranges that hold rows: one small row for each range
    parts = rims.filter("edge = 'first'").select("part")
    around = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("then"))
    last = rims.filter("edge = 'last'").select("no_id", "id", "part", "text").join(around, "part")
    first = rims.filter("edge = 'first'").select(F.col("part").alias("then"), F.col("text").alias("following"))
    met = last.join(first, "then").select("no_id", "id", "text", "following").mapInPandas(meet, f"no_id boolean, id long, {_OUT}")
    out = marks.filter("edge is null").select("no_id", "id", *_NAMES).unionByName(met)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *_NAMES)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op11_fingerprint": (op11, None)}
