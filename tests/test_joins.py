"""Joins with large lexicons and crowded keys, against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threatscan.operators import documents as D
from threatscan.operators import findings as N


def brute_hits(docs, lexicon):
    """By every substring of every text that is as long as some term."""
    terms = {}
    for c, t in lexicon:
        if t:
            terms.setdefault(t, []).append(c)
    sizes = {len(t) for t in terms}
    out = []
    for i, text in docs:
        low = (text or "").lower()
        seen = {low[k : k + n] for n in sizes for k in range(len(low) - n + 1)} & set(terms)
        out += [(i, c, t, low.count(t)) for t in seen for c in terms[t]]
    return sorted(out)


def random_lexicon(n, docs):
    rng = random.Random(2)
    words = [f"term{i:06d}" for i in range(n - 60)]
    words += [f"{a} {b}" for a, b in (rng.sample(words, 2) for _ in range(50))] + ["a", "aa", "aba", "ab", "ß", "é x", "漢"]
    lexicon = [("c" + w[-1], w) for w in words] + [("twice", "aba"), ("none", "")]
    texts = [(i, " ".join(rng.choice(words) for _ in range(200)) + " Ababababa AAAAA É x漢") for i in range(docs)]
    return lexicon, [*texts, (99, None), (100, ""), (101, "Aa")]


def test_a_hundred_thousand_terms(spark):
    lexicon, docs = random_lexicon(100_000, 25)
    df, table = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(lexicon, "category string, term string")
    found = N.phrase_hits(df, table)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # texts stay where they are
    assert sorted(map(tuple, found.collect())) == brute_hits(docs, lexicon)


def test_lexicon_shards_give_the_same(spark, monkeypatch):
    lexicon, docs = random_lexicon(3000, 10)
    df, table = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(lexicon, "category string, term string")
    monkeypatch.setattr(N, "SHARD_CHARS", 8000)
    assert sorted(map(tuple, N.phrase_hits(df, table).collect())) == brute_hits(docs, lexicon)


def test_lexicons_of_many_shards_go_by_runs(spark, monkeypatch):
    """Each way with the same hits: long runs that are cut, long and short terms, rows of one key, equal rows; no automata but for the phrases."""
    lexicon, docs = random_lexicon(3000, 10)
    rng = random.Random(9)
    long = "".join(rng.choice("abc9\u00e9\u6f22") for _ in range(2500))
    lexicon += [("long", long[985:1100]), ("long", long[:40]), ("edge", long[990:1022]), ("edge", long[999:1001]), ("\u00fc", "term000001"), ("\u00fc", "term000001"), ("x", "term000001\n")]
    docs += [(200, f"x {long}-{long[:1500]} term000001\nterm000001"), (200, docs[0][1]), (200, docs[0][1]), (201, "Term000001" * 3)]
    df, table = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(lexicon, "category string, term string")
    shards, real = [], N._shard_hits
    monkeypatch.setattr(N, "SHARD_CHARS", 2000)
    monkeypatch.setattr(N, "_shard_hits", lambda low, terms, key: shards.append(len(terms)) or real(low, terms, key))
    assert sorted(map(tuple, N.phrase_hits(df, table).collect())) == brute_hits(docs, lexicon)
    assert len(shards) == 1 and shards[0] < 60  # the phrases of two words


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_classes(rows, most):
    hs = {}
    for i, h in rows:
        if h is not None:
            hs.setdefault(h, []).append(i)
    keys = np.array(list(hs), dtype=np.uint64)
    near = [np.flatnonzero(np.bitwise_count(keys ^ k) <= most) for k in keys]
    label = list(range(len(keys)))
    todo = set(label)
    while todo:
        stack = [todo.pop()]
        group = []
        while stack:
            k = stack.pop()
            group.append(k)
            for j in near[k]:
                if int(j) in todo:
                    todo.discard(int(j))
                    stack.append(int(j))
        least = min(min(hs[int(keys[k])]) for k in group)
        for k in group:
            label[k] = least
    return sorted((i, label[k], len(near[k]) - 1) for k in range(len(keys)) for i in hs[int(keys[k])])


def classes(spark, rows, **options):
    df = spark.createDataFrame([(i, None if h is None else signed(h)) for i, h in rows], "id long, h long")
    out = D.hash_classes(df, **options).collect()
    assert len(out) == sum(h is not None for _, h in rows)
    return sorted(map(tuple, out))


def test_hash_classes_match_brute_force(spark):
    rng = random.Random(5)
    hs = [rng.getrandbits(64) for _ in range(40)]
    for h in hs[:30]:
        x = h
        for b in rng.sample(range(64), rng.randint(0, 12)):
            x ^= 1 << b
        hs.append(x)
    rows = [*enumerate(hs), (500, hs[3]), (501, hs[3]), (502, None)]
    want = brute_classes(rows, 9)
    assert classes(spark, rows) == want == classes(spark, rows, agree=3)
    assert classes(spark, rows[:1]) == [(0, 0, 0)] and classes(spark, []) == []


def test_near_white_hashes_give_rows_not_pairs(spark, monkeypatch):
    """2,135 different hashes that agree in 52 bits: two rows for each member and key at most."""
    rng = random.Random(6)
    white = (1 << 64) - 1
    hs = [white ^ (k * 0x9E3779B1 % 4096) for k in rng.sample(range(4096), 2135)]
    rows = list(enumerate(dict.fromkeys(hs)))
    want = brute_classes(rows, 9)
    assert classes(spark, rows) == want
    monkeypatch.setattr(D, "PART", 300)  # dealt into parts that meet two by two
    assert classes(spark, rows) == want
    h = np.array([h for _, h in rows], dtype=np.uint64)
    walked = D._walked(np.zeros(len(h), np.int64), h, 3, 3, 11, 9)
    assert len(walked) <= 2 * len(h)


def test_hash_pairs_of_crowded_keys(spark, monkeypatch):
    """Parts that meet two by two give each near pair once; every hash is filed under ten keys, not hundreds."""
    rng = random.Random(7)
    white = (1 << 64) - 1
    hs = list(dict.fromkeys([white ^ rng.getrandbits(14) for _ in range(700)] + [rng.getrandbits(64) for _ in range(300)]))
    rows = [*enumerate(hs), (5000, hs[3]), (None, 5), (5001, None)]
    h = np.array(hs, dtype=np.uint64)
    want = sorted((a, int(b), int(d)) for a in range(len(h)) for b, d in enumerate(np.bitwise_count(h ^ h[a])) if a < b and d <= 9)
    df = spark.createDataFrame([(i, None if x is None else signed(x)) for i, x in rows], "id long, h long")
    monkeypatch.setattr(D, "PART", 64)
    assert sorted(map(tuple, D.hash_pairs(df).collect())) == want
    monkeypatch.undo()
    reps = df.filter("h is not null").groupBy("h").agg(F.min("id").alias("first"))
    agree = D._agreeing(200_000)
    assert D._dealt(reps, 9 + agree, agree).count() <= 10 * (len(hs) + 1)


def test_image_pairs_and_classes_of_the_tables(spark):
    """``phash_pairs`` gives every near pair with its distance; its links are those that ``phash_classes`` counts."""
    queries = entry.queries()
    pairs = queries["phash_pairs"](spark, "/root/testdata/sf0.001")
    assert pairs.columns == ["a", "b", "distance"]
    pairs = [tuple(r) for r in pairs.collect()]
    kept = {r.id: (r.class_id, r.n_links) for r in queries["phash_classes"](spark, "/root/testdata/sf0.001").collect()}
    assert pairs and max(d for *_, d in pairs) <= 9 and all(kept[a][0] == kept[b][0] for a, b, _ in pairs)
    links = Counter(i for a, b, _ in pairs for i in (a, b))
    assert all(kept[i][1] == n for i, n in links.items())
