"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations that begin with the same turns share the nodes of those turns. A
node is known by its depth and 128 bits over the numbered turns before it, and
named by the smallest conversation that passes through it. What a subtree holds
is gathered by a centroid decomposition of the parent edges: every component is
split at the node that leaves no part with more than half of its weight, the
total of what lies below that node is added along the path from it to the
component's top, and the parts are components of the next round. A path of a
million turns thus takes some twenty rounds, and no step follows a branch node
by node.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatscan.llm.common import WORD, bound_batches, stored, table

#: A key with more than this part of all rows is hot; so there are at most as many hot keys.
HOT = 1000
#: Ids of one row of a list that is too long for one.
CHUNK = 4096


def _met(rows: DataFrame, other: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``other``, which has each key once and in ``size`` how many rows it will meet, ``total`` in all. The at most ``HOT`` keys that meet over a ``HOT``-th of the rows are broadcast, so that no task gets all rows of one key."""
    hot = F.col(size) > total // HOT + 1
    few = F.broadcast(other.filter(hot))
    met = rows.join(few, keys)
    return met.unionByName(rows.join(few, keys, "left_anti").join(other.filter(~hot), keys))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows (conv_id, turn, role, text)`` as ``conv_id, block, pos, told, words``: the place of each turn in its conversation, from 1, with a digest in place of role and text.

    The turns are dealt out by ranges, so that a conversation with a third of
    all turns lies in many blocks; the turns of a block are counted on from
    the blocks before it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    cut = rows.filter("conv_id is not null").select("conv_id", "turn", told.alias("told"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    cut = stored(cut.repartitionByRange("conv_id", "turn", "told").withColumn("block", F.spark_partition_id()))
    before = cut.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("conv_id", "block", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("conv_id", "block").orderBy("turn", "told"))
    placed = cut.select("conv_id", "block", own.alias("own"), "told", "words")
    return placed.join(before, ["conv_id", "block"]).select("conv_id", "block", (F.col("before") + F.col("own")).alias("pos"), "told", "words")


def rebuilt(turns: DataFrame, group: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations of which the first turns are those of the first one of their ``group`` of numbers.

    Conversation ``c`` takes the first ``crc32(c) % longest`` turns from
    conversation ``c - c % group`` and keeps its own after as many. Returns
    ``(conv_id, length)`` and ``(conv_id, block, depth, told, words)``, each
    stored; what comes from the other conversation is block -1.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest)
    given = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < longest)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "told", "words")
    sizes = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    first = convs.join(given, "base").filter("depth <= h").select("conv_id", F.lit(-1).alias("block"), "depth", "told", "words")
    # what the conversation tells is brought to its blocks, not to its turns
    blocks = turns.select("conv_id", "block").distinct().join(convs, "conv_id").select("conv_id", "block", "h", "k")
    own = turns.join(blocks, ["conv_id", "block"]).filter("pos > h").select("conv_id", "block", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "told", "words")
    return convs.select("conv_id", "length"), stored(first.unionByName(own))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, a, b, pa, pb, words, length)``: 128 bits over each conversation's first ``depth`` turns and over all of these but the last; depth 0 has no turns.

    The bits are an exclusive or over numbered turns, so they are put together
    from blocks of a conversation.
    """
    terms = turns.select("conv_id", "block", "depth", "words", F.xxhash64("depth", "told").alias("x"), F.xxhash64(F.lit(1), "told", "depth").alias("y"))
    inside = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = terms.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = before.select("conv_id", "block", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "xy"))
    before = before.join(convs, "conv_id")
    run = terms.select("*", F.bit_xor("x").over(inside).alias("x1"), F.bit_xor("y").over(inside).alias("y1")).join(before, ["conv_id", "block"])
    run = run.select("conv_id", F.col("depth").cast("long").alias("depth"), F.expr("x0 ^ x1").alias("a"), F.expr("y0 ^ y1").alias("b"), F.expr("x0 ^ x1 ^ x").alias("pa"), F.expr("y0 ^ y1 ^ y").alias("pb"), "words", "length")
    none = F.lit(0).cast("long")
    return run.unionByName(convs.select("conv_id", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("pa"), none.alias("pb"), none.alias("words"), "length"))


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the subtree of each node, by centroid decomposition.

    ``nodes (c, d, weight, *values)``: a node is named by a conversation and its
    depth, and ``weight`` is what its whole subtree weighs, at least one a node.
    ``paths (conv, depth, owner, above)``: the node at each depth of each
    conversation, and the one above it. Returns ``(c, d, *values)``. Every
    round halves the weight of the heaviest component at least; components of
    one node are done. Nothing but a few counts reaches the driver.
    """
    key, top = ["c", "d"], ["top_c", "top_d"]
    start = nodes.agg(F.min_by("c", "d").alias("top_c"), F.min("d").alias("top_d"))
    active = stored(nodes.select(*key, "weight", *values).crossJoin(F.broadcast(start)))  # one row: the root
    added, left = [], active.count()
    while left:
        parts = stored(active.groupBy(*top).agg(F.max("weight").alias("whole"), F.count(F.lit(1)).alias("n"), F.max(F.struct(*key)).alias("only")))
        single = parts.filter("n = 1").select(*top, "n")
        heavy = _met(active, parts.filter("n > 1"), top, "n", left).filter("2 * weight > whole")
        centres = heavy.groupBy(*top).agg(F.max(F.struct("d", "c", "weight")).alias("x"), F.max("n").alias("n"))
        centres = stored(centres.select(*top, "n", F.col("x.c").alias("x_c"), F.col("x.d").alias("x_d"), F.col("x.weight").alias("x_weight")))
        # a component of one node is its own total
        added.append(stored(_met(active, single, top, "n", left).select(*key, *values)))
        seen = _met(active, centres, top, "n", left)
        below = seen.filter("d > x_d").withColumn("next_d", F.col("x_d") + 1)
        step = paths.select(F.col("conv").alias("c"), F.col("depth").alias("next_d"), F.col("owner").alias("next_c"), "above")
        below = below.join(step, ["c", "next_d"]).withColumn("under", F.col("above") == F.col("x_c"))
        kept = [*key, "weight", *values, *top, "x_c", "x_d", "x_weight", "next_c", "next_d", "under"]
        none = F.lit(None).cast("long")
        rest = seen.filter("d <= x_d").withColumn("next_c", none).withColumn("next_d", none).withColumn("under", (F.col("d") == F.col("x_d")) & (F.col("c") == F.col("x_c")))
        split = stored(below.select(*kept).unionByName(rest.select(*kept)))
        totals = split.filter("under").groupBy(*top).agg(F.max(F.struct("x_c", "x_d", "x_weight")).alias("x"), *(F.sum(v).alias(v) for v in values))
        totals = stored(totals.select(*top, "x.*", *values))
        # the path from each centroid to its component's top, the centroid included
        path = totals.select(F.col("x_c").alias("conv"), F.explode(F.sequence("top_d", "x_d")).alias("depth"), "x_weight", *values)
        path = stored(path.join(paths.select("conv", "depth", "owner"), ["conv", "depth"]).select(F.col("owner").alias("c"), F.col("depth").alias("d"), "x_weight", *values))
        added.append(path.select(*key, *values))
        parted = split.filter("under and next_c is not null").select(*key, "weight", *values, F.col("next_c").alias("top_c"), F.col("next_d").alias("top_d"))
        above = split.filter("not under").join(path.select(*key, F.col("x_weight").alias("less")), key, "left")
        above = above.select(*key, (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"), *values, *top)
        active = stored(parted.unionByName(above))
        left = active.count()
        if left:
            paths = stored(paths.join(active.select(F.col("c").alias("conv")).distinct(), "conv", "left_semi"))
    whole = added[0] if added else nodes.select(*key, *values)
    for x in added[1:]:
        whole = whole.unionAll(x)
    return whole.groupBy(*key).agg(*(F.sum(v).alias(v) for v in values))


def list_digests(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """SHA-256 of the comma-joined numbers of each key, ascending: ``(*key, sha256)``. Lists of any length go through the hash chunk by chunk, in order."""
    bound_batches(rows.sparkSession)
    kinds = ", ".join(f"{k} long" for k in key)

    names = [*key, "least", "ids"]

    def joined(batches):
        now, ids, out = None, [], []
        for pdf in batches:
            for *k, i in zip(*(pdf[c].tolist() for c in (*key, number)), strict=True):
                if k != now or len(ids) == CHUNK:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = k, []
                ids.append(i)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if ids:
            out.append((*now, ids[0], ",".join(map(str, ids))))
        yield pd.DataFrame(out, columns=names)

    def digests(batches):
        now, h, out = None, None, []
        for pdf in batches:
            for *k, ids in zip(*(pdf[c].tolist() for c in (*key, "ids")), strict=True):
                if k != now:
                    if h is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*key, "sha256"])
            out = []
        if h is not None:
            yield pd.DataFrame([(*now, h.hexdigest())], columns=[*key, "sha256"])

    chunks = rows.select(*key, number).repartitionByRange(*key, number).sortWithinPartitions(*key, number).mapInPandas(joined, f"{kinds}, least long, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "least").mapInPandas(digests, f"{kinds}, sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations ``(conv_id, length)`` with the turns ``(conv_id, block, depth, told, words)``."""
    passed = stored(prefixes(convs, turns))
    bits = ["depth", "a", "b"]
    grouped = passed.groupBy(*bits).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words"))
    grouped, total = stored(grouped), passed.count()
    # the node above; it has at most as many children as conversations
    under = grouped.filter("depth > 0").withColumn("up", F.col("depth") - 1)
    uppers = grouped.select(F.col("depth").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("above"), F.col("n_convs").alias("meets"))
    under = _met(under, uppers, ["up", "pa", "pb"], "meets", total).select(*bits, "owner", "above", "n_convs", "weight", "words")
    roots = grouped.filter("depth = 0").select(*bits, "owner", F.lit(None).cast("long").alias("above"), "n_convs", "weight", "words")
    nodes = stored(under.unionByName(roots))
    paths = _met(passed.select("conv_id", *bits, "length"), nodes.select(*bits, "owner", "above", F.col("n_convs").alias("meets")), bits, "meets", total)
    paths = stored(paths.select(F.col("conv_id").alias("conv"), "depth", "owner", "above", (F.col("depth") == F.col("length")).alias("ends")))
    children = nodes.filter("depth > 0").groupBy(F.col("above").alias("c"), (F.col("depth") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.select(F.col("owner").alias("c"), F.col("depth").alias("d"), "above", "n_convs", "weight", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    nodes = stored(nodes.join(children, ["c", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")))
    sums = rollup(nodes, paths.select("conv", "depth", "owner", "above"), ["n_leaves", "saved_tokens"])
    ended = list_digests(paths.filter("ends").select(F.col("owner").alias("c"), F.col("depth").alias("d"), "conv"), ["c", "d"], "conv")
    out = nodes.select("c", "d", "above", "n_convs", "n_children").join(sums, ["c", "d"]).join(ended, ["c", "d"], "left")
    long = lambda name: F.col(name).cast("long")
    return out.select(
        long("c").alias("conv_id"), long("d").alias("depth"), long("above").alias("parent_conv_id"), long("n_convs"), long("n_children"), long("n_leaves"), long("saved_tokens"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations (conv_id, turn, role, text)`` as they stand: one row for each node.

    Turns are ordered by turn number, null numbers first, rows of one number by
    a digest of role and text; repeated rows are turns of their own. Null roles
    and texts are empty. Rows without a conversation id belong to no
    conversation. Other columns are not read. An empty table has no node.
    """
    turns = stored(numbered(conversations.select("conv_id", "turn", "role", "text")))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    return trie(stored(convs), turns.withColumnRenamed("pos", "depth"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return trie(*rebuilt(turns))


#: CRC-32 of a number's decimal form, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1))), 4294967295)"
SQL = rf"""WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', role, text))) AS pos,
  sha256(concat(length(coalesce(role, '')), ':', role, text)) AS told, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM o GROUP BY conv_id),
c AS (SELECT x.conv_id, x.base, x.h, least(x.h, coalesce(y.n, 0)) AS k, least(x.h, coalesce(y.n, 0)) + greatest(x.n - x.h, 0) AS length FROM c0 x LEFT JOIN c0 y ON y.conv_id = x.base),
r AS (SELECT c.conv_id, o.pos AS depth, told, words FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.pos - c.h + c.k, told, words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
p0 AS (SELECT conv_id, depth, words, sha256(string_agg(told, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
p AS (SELECT p0.*, lag(p0.k) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = length AS ends FROM p0 JOIN c USING (conv_id)),
n AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY depth, k),
m AS (SELECT n.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM n z WHERE z.depth = n.depth + 1 AND z.up = n.k) AS n_children FROM n LEFT JOIN n q ON q.depth = n.depth - 1 AND q.k = n.up),
s AS (SELECT p.depth, p.k, sum(CASE WHEN p.conv_id = m.conv_id THEN (m.n_convs - 1) * m.words ELSE 0 END) OVER w AS saved, sum(CASE WHEN p.conv_id = m.conv_id AND m.n_children = 0 THEN 1 ELSE 0 END) OVER w AS leaves
  FROM p JOIN m ON m.depth = p.depth AND m.k = p.k WINDOW w AS (PARTITION BY p.conv_id ORDER BY p.depth DESC))
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens, ends_sha256
FROM m JOIN s USING (depth, k) GROUP BY conv_id, depth, parent_conv_id, n_convs, n_children, ends_sha256"""

QUERIES = {"op13_trie": (op13, SQL)}
