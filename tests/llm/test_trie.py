"""The conversation trie against brute force."""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from threatscan.llm import trie

KINDS = "conv_id long, turn long, role string, text string, depth string"


def told(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, rebuild=True):
    """Every node by walking every conversation."""
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0, told(role or "", text or "")), (role or "", text or "")))
    own = {c: [x[1] for x in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - int(np.fmod(c, 20)), [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    for k, members in nodes.items():
        cost = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + cost
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in children)
    out = set()
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(own[c]) == len(k))))
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_rows(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(60), -3, -20, 1_000_000_007]:
        for t in range(int(rng.integers(1, 7))):
            role = ["user", "assistant", None][int(rng.integers(0, 3))] if t else "user"
            text = ["same words here", "other\twords", None, "", f"own {c}"][int(rng.choice(5, p=[0.45, 0.3, 0.05, 0.05, 0.15]))]
            rows.append((c, None if rng.random() < 0.1 else int(rng.integers(0, 4)), role, text, "x"))
    rows += rows[:5]  # repeated rows are turns of their own
    rows += [(None, 0, "user", "nobody's", "x")]
    return rows


def nodes(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_nodes_match_brute_force(spark):
    for seed in (1,):
        rows = random_rows(seed)
        df = spark.createDataFrame(rows, KINDS)
        turns = trie.stored(trie.numbered(df))
        assert nodes(trie.trie(*trie.rebuilt(turns))) == brute(rows)
        assert nodes(trie.conversation_trie(df)) == brute(rows, rebuild=False)


def test_empty_tables(spark):
    none = spark.createDataFrame([], KINDS)
    assert trie.conversation_trie(none).count() == 0
    assert trie.trie(*trie.rebuilt(trie.stored(trie.numbered(none)))).count() == 0
    one = spark.createDataFrame([(7, None, None, None, "x")], KINDS)
    assert nodes(trie.conversation_trie(one)) == brute([(7, None, None, None)], rebuild=False)


def test_a_conversation_that_holds_most_turns_lies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(1, t, "user", f"turn {t % 7}", "x") for t in range(300)] + [(c, t, "user", f"turn {t % 7}", "x") for c in range(2, 30) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, KINDS)
        turns = trie.stored(trie.numbered(df))
        assert turns.filter("conv_id = 1").select("block").distinct().count() > 1
        assert [r.pos for r in turns.filter("conv_id = 1").orderBy("pos").collect()] == list(range(1, 301))
        assert nodes(trie.trie(*trie.rebuilt(turns))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rollup_of_a_long_path_takes_few_rounds(spark, monkeypatch):
    """120 nodes in a row with a fan at the end: rounds by halving, not node by node."""
    stores = []
    keep = trie.stored
    monkeypatch.setattr(trie, "stored", lambda df: stores.append(1) or keep(df))
    depth, fan = 120, 20
    path = [(0, d, depth - d + fan, 1, d) for d in range(depth)] + [(c, depth, 1, 1, 7) for c in range(fan)]
    own = [(0, d, 0, 0 if d else None) for d in range(depth)]
    ways = own + [(c, d, 0, 0 if d else None) for c in range(1, fan) for d in range(depth)] + [(c, depth, c, 0) for c in range(fan)]
    df = spark.createDataFrame(path, "c long, d long, weight long, one long, own long")
    paths = spark.createDataFrame(ways, "conv long, depth long, owner long, above long")
    got = {(r.c, r.d): (r.one, r.own) for r in trie.rollup(df, paths, ["one", "own"]).collect()}
    assert len(got) == depth + fan and len(stores) < 9 * 8
    for d in range(depth):
        assert got[0, d] == (depth - d + fan, sum(range(d, depth)) + 7 * fan)


def test_list_digests_go_through_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    df = spark.range(1000).select((F.col("id") % 3).alias("c"), F.lit(1).cast("long").alias("d"), F.col("id").alias("conv"))
    got = {r.c: r.sha256 for r in trie.list_digests(df, ["c", "d"], "conv").collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(k, 1000, 3)).encode()).hexdigest() for k in range(3)}
