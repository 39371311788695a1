import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from threatscan.llm import simhash
from threatscan.llm.common import components


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh)) if sh else 0


def brute_groups(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_real_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fp(t) for i, t in texts.items()}
    got = simhash.op5(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_groups(fps, 3)


def test_xxhash_is_spark_xxhash64(spark):
    words = ["a b c", "é ß \U0001f600", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h"))
    assert [r.h & (1 << 64) - 1 for r in df.collect()] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def random_fps(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            f = rng.choice(out)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
        else:
            f = rng.getrandbits(64)
        out.append(f)
    return dict(enumerate(dict.fromkeys(out)))


def linked(spark, fps, most):
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "id long, fp long")
    got = {r.id: r.component for r in components(simhash.links(df, 3, 6, most)).collect()}
    return {i: got.get(i, i) for i in fps}


def test_blocks_lose_no_link(spark):
    fps = random_fps(400, 1)
    assert linked(spark, fps, 4096) == brute_groups(fps, 3)


def test_crowded_keys_take_the_exact_other_way(spark):
    fps = random_fps(60, 2)
    assert linked(spark, fps, 1) == brute_groups(fps, 3)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "  \n", 7), (4, "one", 8), (4, "one", 8), (5, "ONE", 9), (6, "a b c d", 1), (None, "one", 1)], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()))
    assert got == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def jaccard(a, b, k=5):
    s = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_similar_groups_near_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for base in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 400]))]
        texts[base] = " ".join(w)
        for c in range(3):
            v = list(w)
            for _ in range(max(1, int(len(w) * rng.choice([0.002, 0.01, 0.03, 0.1])))):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            texts[1000 * (c + 1) + base] = " ".join(v)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    sure = wrong = 0
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if a % 1000 != b % 1000:
                assert got[a] != got[b]
                continue
            if jaccard(texts[a], texts[b]) >= 0.8:
                sure += 1
                wrong += got[a] != got[b]
    assert sure > 30 and wrong == 0


def test_one_of_each(spark):
    t = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(3, t, "x"), (1, t, "y"), (1, t, "y"), (2, t + " more", "z"), (4, "other text here", "q"), (None, "kept", "n")], "doc_id long, text string, __gone string")
    got = sorted((r.doc_id or 0) for r in simhash.one_of_each(df).collect())
    assert got == [0, 1, 4]
    other = " ".join(f"u{i}" for i in range(100))
    rows = [(1, t, 7), (2, t + " x", 8), (2, other, 9), (3, other + " y", 1), (2, None, 2), (5, "", 3)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, tk long")).collect()
    assert sorted((r.doc_id, r.tk) for r in got) == [(1, 7), (2, 2), (2, 9)]  # rows of one id are told apart by their texts


def test_sketch_estimates_similarity():
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(50, 1050))
    sa, sb = (np.frombuffer(simhash.slot_sketch(x, 5)[0], dtype=np.uint8) for x in (a, b))
    assert simhash._similar(sa, sb[None], 0.8)[0] and not simhash._similar(sa, sb[None], 0.98)[0]


def test_similar_groups_are_exact_also_in_crowded_keys(spark):
    rng = random.Random(9)
    texts = {}
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(120)]
        for v in range(8):
            one = list(base)
            for at in rng.sample(range(120), 6):
                one[at] = f"v{family}x{v}x{at}"
            for c in range(2):
                two = list(one)
                for at in rng.sample(range(120), rng.randint(2, 3) * c):
                    two[at] = f"c{rng.randrange(10**9)}"
                texts[100 * family + 10 * c + v] = " ".join(two)
    want, ids = {i: i for i in texts}, sorted(texts)
    links = [(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    for _ in ids:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert len(set(want.values())) > 20 and len(links) > 20
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for bounds in ({}, {"most": 3}, {"shingles": 300}):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(df, **bounds).collect()} == want, bounds


def test_every_pair_of_a_crowded_key_meets(spark):
    nodes = spark.createDataFrame([(i, 100 + i % 7, [5]) for i in range(50)], "id long, n long, bands array<long>")
    groups = {}
    for r in simhash._meetings(nodes, 0.8, 8, 10**6).collect():
        groups.setdefault(r.g, set()).add(r.id)
    assert {(a, b) for g in groups.values() for a in g for b in g} == {(a, b) for a in range(50) for b in range(50)}
    assert max(map(len, groups.values())) < 25


def test_one_of_each_takes_simhash_links(spark):
    """Fingerprints at 3 bits link, also where the sets of shingles are less alike than the bands look for."""
    w, rng = [f"w{i}" for i in range(300)], random.Random(132)
    v = list(w)
    for at in rng.sample(range(300), 9):
        v[at] = f"x132y{at}"
    a, b = " ".join(w), " ".join(v)
    prints = [simhash.simhash([simhash.shingle_set(x, 5)]) for x in (a, b)]
    assert (prints[0] ^ prints[1]).bit_count() == 3 and jaccard(a, b) < 0.8
    rows = [(1, a), (2, b), (3, " ".join(f"u{i}" for i in range(300))), (4, None)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4]


def test_simhash_links_with_repeated_fingerprints(spark):
    rng = random.Random(12)
    fps = list(random_fps(80, 3).values())
    rows = [(i, f) for i, f in enumerate([*fps, *rng.sample(fps, 20)])]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "id long, fp long")
    want = {i: i for i, _ in rows}
    for _ in rows:
        for i, f in rows:
            for j, g in rows:
                if (f ^ g).bit_count() <= 3:
                    want[i] = want[j] = min(want[i], want[j])
    got = {r.id: r.component for r in components(simhash.simhash_links(df)).collect()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) < len(fps)
