"""Fingerprints and fill-in-middle against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatscan.llm import fingerprint as fp
from threatscan.llm import middle


def plain_hash(text, k):
    m, b = fp.PRIMES[k], fp.BASES[k]
    return sum((ord(c) + 1) * pow(b, i, m) for i, c in enumerate(text)) % m


def texts(seed, n):
    rng = np.random.default_rng(seed)
    letters = list("ab é\n漢😀")
    return ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(n)]


def test_prefixes_spans_and_extensions():
    for a, b in zip(texts(1, 40), texts(2, 40), strict=True):
        x, y = fp.Prefixes.of(a), fp.Prefixes.of(b)
        assert [int(p[-1]) for p in x.arrays] == [plain_hash(a, k) for k in range(4)] and x.n == len(a)
        i, j = (v.ravel() for v in np.meshgrid(np.arange(len(a) + 1), np.arange(len(b) + 1)))
        ahead = x.extension(i, y, j)
        behind = x.extension(i, y, j, back=True)
        for p, q, f, r in zip(i, j, ahead, behind, strict=True):
            n = 0
            while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                n += 1
            m = 0
            while m < min(p, q) and a[p - m - 1] == b[q - m - 1]:
                m += 1
            assert (f, r) == (n, m)


def test_spliced_arrays_are_those_of_the_text():
    for a, b in zip(texts(3, 30), texts(4, 30), strict=True):
        text, keep, take = fp._edited(a, b)
        assert fp.Prefixes.of(a).spliced(keep, fp.Prefixes.of(b), take).fingerprint() == fp.Prefixes.of(text).fingerprint()


def test_likeness():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    a, b = (" ".join(word() for _ in range(300)) for _ in range(2))
    like = lambda s, t: fp.likeness(fp.Prefixes.of(s), fp.Prefixes.of(t))
    assert like(a, a) == like("", "") == 1 and like("", a) == like(a, "") == 0
    assert like(a, b) < 0.02 and like(b, a) < 0.02
    assert abs(like(a, a[:1400] + b[1400:2100]) - 2 / 3) < 0.02
    assert like(a, "new words in front " + a) > 0.98  # a shift costs what it adds
    assert like(a, a[700:] + a[:700]) == 1 and like(a, a[:1000] + b[:40] + a[1000:]) > 0.97
    assert 0 <= like("abc", "abd") < 1 and like("x" * 500, "x" * 400) == 1


def in_order(rows):
    """Rows as the next-document order has them; the hash of equal ids is Spark's."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_rows_meet_the_next_document(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), t) for i, t in zip(rng.permutation(200), [*texts(7, 195), None, "", "long " * 30_000, "same", "same"], strict=True)] + [(None, "nobody's")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).repartition(5)
        got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 201
    ordered = in_order(rows)
    for (i, t), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        r, x, y, z = got[i], *(fp.Prefixes.of(v) for v in (t, edited, following))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (x.fingerprint(), y.fingerprint())
        assert r.near_edited == pytest.approx(fp.likeness(x, y)) and r.near_next == pytest.approx(fp.likeness(x, z)) and 0 <= r.near_next <= 1
        assert r.near_edited >= 0.6 or len(t) < 3


def test_few_rows(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    r = fp.fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1
    assert fp.fingerprints(one.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "aaa"), (1, "bbb"), (1, "bbb"), (None, None)], "doc_id long, text string")
    out = fp.fingerprints(ties).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out}) == 3


def test_likeness_of_the_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = fp.fingerprints(docs).toPandas()
    assert (out.near_edited >= 0.6).all() and out.near_next.median() < 0.1


MARKED = "keep <S> as it is\n"


def brute_middle(i, text):
    text = text or ""
    n = len(re.findall(r"[^\n]*\n|[^\n]+", text))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = ("".join(p) for p in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_frames_find_every_unit():
    for text in [*texts(8, 60), "no end", "\n", "\n\n\n", "é" * 50, "ab\n" + "漢" * 40 + "\nlast"]:
        for size in (4, 7, 64):
            held = middle.Frames(middle.frames_of(text, size))
            units = re.findall(r"[^\n]*\n|[^\n]+", text)
            assert held.n == len(units) and held.end[2] == len(text)
            for u in range(len(units) + 1):
                at = held.place(u)
                assert at[2] == sum(map(len, units[:u]))
                assert b"".join(held.stream((0, 0, 0), at)).decode() == "".join(units[:u])
                assert b"".join(held.stream(at, held.end)).decode() == "".join(units[u:])


def test_texts_come_back_from_their_streams():
    for text in [*texts(9, 40), "<<\n<\nP>\n<", "S>\nM>\n<P", ">\n>\n"]:
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        held = middle.Frames(middle.frames_of(text, 5))
        for form in ("plain", "psm", "spm"):
            for a in range(held.n + 1):
                for b in range(a, held.n + 1):
                    out = lambda: middle.output(held, form, held.place(a), held.place(b))  # noqa: B023, E731
                    assert b"".join(middle.restored(out, form)).decode() == text


def test_middles_match_brute_force(spark):
    long = "\n".join(f"line {i} é" for i in range(40_000))
    rows = [*enumerate(texts(10, 80)), (100, None), (101, ""), (102, MARKED), (103, long), (104, "x" * 300_000), (105, "\n" * 200_000), (1, "again\none"), (1, "again\none"), (None, "a\nb\nc\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(map(repr, ((i, *(w := brute_middle(i, t))[:4], sha(w[4]), sha(t or "")) for i, t in rows)))
    got = middle.digests(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    made = middle.fill_in_middle(df).collect()
    assert sorted(repr((r.doc_id, r.output)) for r in made) == sorted(repr((i, brute_middle(i, t)[4])) for i, t in rows)
    assert {r.form for r in middle.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in middle.fill_in_middle(df, spm=100).collect()} == {"plain", "spm"}
    assert middle.digests(df.limit(0)).count() == 0
