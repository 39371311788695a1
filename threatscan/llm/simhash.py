"""SimHash near-duplicates found by pigeonhole blocks.

A fingerprint is 64 bits. Two of them at ``radius`` or fewer differing bits
agree in at least ``blocks - radius`` of ``blocks`` bit blocks, so each
fingerprint is filed under every choice of that many blocks; what shares a
block key is verified by Hamming distance. Equal fingerprints are merged first,
so a text copied a million times is one row here.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatscan.llm.common import bound_batches, components, fresh, stored, table

_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of each byte value, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Shingles hashed at a time; bounds memory on very long texts.
_STEP = 200_000


def shingle_hashes(text: str | None, k: int):
    """Arrays of XXH64 (seed 42) of the ``k``-word shingles of a text, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not w:
        return
    h, j = xxhash.xxh64_intdigest, b" ".join
    if len(w) < k:
        yield np.array([h(j(w), 42)], dtype=np.uint64)
        return
    for at in range(0, len(w) - k + 1, _STEP):
        part = w[at : at + _STEP + k - 1]
        yield np.fromiter((h(x, 42) for x in map(j, zip(*(part[i:] for i in range(k)), strict=False))), dtype=np.uint64)


def simhash(hashes) -> int:
    """The 64-bit SimHash of arrays of hashes: a bit is 1 if it is set in over half of them; 0 without any."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        n += len(h)
        rows = h.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            ones[8 * b : 8 * b + 8] += np.bincount(rows[:, b], minlength=256) @ _BITS
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint(text: str | None, k: int = 3) -> int:
    """The SimHash of the shingles of a text, repeats included."""
    return simhash(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, k: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with ``fp`` (long, the fingerprint's bits) in place of the text column."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(s: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(x, k) for x in s), dtype=np.uint64, count=len(s)).view(np.int64))

    return docs.select("*", fp(F.col(text)).alias("fp")).drop(text)


def _bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def block_keys(radius: int, blocks: int):
    """The columns of block keys of ``fp``: one for each choice of ``blocks - radius`` blocks, tagged by the choice."""
    keys = []
    for n, chosen in enumerate(combinations(_bounds(blocks), blocks - radius)):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in chosen)
        keys.append(F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*keys)


def _spanning(fps: np.ndarray, radius: int):
    """Edges (index pairs) that connect what is within ``radius``: a breadth-first walk, each step against what is not yet reached."""
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            for x in rest[near]:
                yield at, x
            queue.extend(rest[near])
            rest = rest[~near]


def _ball(radius: int) -> list[int]:
    """All 64-bit masks with ``radius`` bits or fewer."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]


def links(fps: DataFrame, radius: int = 3, blocks: int = 6, most: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` of ids that connect all rows of ``fps (id, fp)``, with distinct ``fp``, within ``radius`` bits.

    They connect what linked pairs connect, but not every linked pair is
    listed: inside a block key a spanning walk is enough. A key with over
    ``most`` fingerprints is not gathered: its members meet at shared masked
    fingerprints instead (``_meet``), which is exact and grows in proportion.
    """
    keyed = stored(fps.select("id", "fp", F.explode(block_keys(radius, blocks)).alias("k")).select("id", "fp", "k.*"))
    sizes = keyed.groupBy("choice", "key").count().filter("count > 1")
    many = stored(keyed.join(sizes, ["choice", "key"]).select("choice", "key", "id", "fp", "count"))
    groups = many.filter(F.col("count") <= most).groupBy("choice", "key").agg(F.collect_list(F.struct("id", "fp")).alias("g")).select("g.id", "g.fp")

    def walk(batches):
        for pdf in batches:
            a, b = [], []
            for ids, f in zip(pdf["id"], pdf["fp"], strict=True):
                order = np.argsort(ids)
                ids, f = np.asarray(ids)[order], np.asarray(f)[order].view(np.uint64)
                for i, j in _spanning(f, radius):
                    a.append(ids[i])
                    b.append(ids[j])
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    bound_batches(fps.sparkSession)
    near = groups.mapInPandas(walk, "a long, b long")
    return near.unionAll(_meet(many.filter(F.col("count") > most).select("id", "fp").distinct(), radius))


def _meet(fps: DataFrame, radius: int) -> DataFrame:
    """Edges among fingerprints of crowded keys, without pairs.

    x and y are within r bits exactly if some value is within floor(r/2) of one
    and ceil(r/2) of the other. Each row is filed under all values near it; at a
    value the nearest members (floor) link the others (ceil) as one star.
    """
    low, high = radius // 2, radius - radius // 2
    near = set(_ball(low))
    masks = _ball(high)

    def spread(batches):
        m, is_low = np.array(masks, dtype=np.uint64), np.array([x in near for x in masks])
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                v = part["fp"].to_numpy().view(np.uint64)[:, None] ^ m[None, :]
                yield pd.DataFrame({"value": v.ravel().view(np.int64), "id": np.repeat(part["id"].to_numpy(), len(m)), "low": np.tile(is_low, len(part))})

    met = fps.mapInPandas(spread, "value long, id long, low boolean")
    hub = met.groupBy("value").agg(F.min(F.when(F.col("low"), F.col("id"))).alias("hub"), F.count(F.lit(1)).alias("n")).filter("hub is not null and n > 1")
    return met.join(hub, "value").filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, blocks: int = 6, most: int = 4096) -> DataFrame:
    """``(doc_id, fp, component_id)``: the group of each document, named by its smallest ``doc_id``.

    Null and empty texts, and texts without words, have fingerprint zero and
    link like any other. Repeated ``doc_id`` values stay as separate rows of one
    group if their texts match. Columns other than ``doc_id`` and ``text`` are
    not read. An empty table gives an empty result.
    """
    fp = stored(fingerprints(docs.select("doc_id", "text"), k))
    nodes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(links(nodes.filter("id is not null"), radius, blocks, most))
    named = nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


#: Bands and minima in a band: two texts of similarity s share a band with probability 1 - (1 - s**4)**20, 0.99997 at 0.8.
BANDS, ROWS = 20, 4
#: Slots of a sketch that estimates similarity; at 0.8 the estimate's standard deviation is 0.018.
SLOTS = 512
#: Shingles of the texts compared in one task, about; bounds a worker's memory.
SHINGLES = 2_000_000
_MULTIPLIERS = np.random.default_rng(7).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of the bands of a set of shingle hashes."""
    minima = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _MULTIPLIERS
        minima = np.minimum(minima, (part ^ (part >> np.uint64(29))).min(axis=0))
    bands = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(minima.reshape(BANDS, ROWS))]
    return list(np.array(bands, dtype=np.uint64).view(np.int64))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, k)]))


def slot_sketch(text: str | None, k: int) -> tuple[bytes, list[int]]:
    """The least shingle hash of each slot, as one byte (0: none), and the keys of the bands."""
    low, h = np.full(SLOTS, ~np.uint64(0)), shingle_set(text, k)
    np.minimum.at(low, (h % SLOTS).astype(np.int64), h // np.uint64(SLOTS))
    sketch = np.where(low == ~np.uint64(0), 0, low % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return sketch.tobytes(), band_keys(h)


def _similar(one: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
    """Which of ``rest`` have an estimated similarity of ``least`` or more with ``one``; equal bytes by chance are allowed for."""
    used = ((rest | one) > 0).sum(axis=1)
    same = ((rest == one) & (rest > 0)).sum(axis=1)
    return (used == 0) | ((same / np.maximum(used, 1) - 1 / 255) / (1 - 1 / 255) >= least)


def _spanning_similar(sets: list[np.ndarray], least: float):
    """Edges (index pairs) that connect what has a Jaccard similarity of ``least`` or more: a walk as in ``_spanning``, on exact counts of common shingles."""
    sizes = np.array([len(x) for x in sets])
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    since = np.searchsorted(ids[order], np.arange(ids.max() + 2 if len(ids) else 1))
    rest = np.arange(len(sets))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            own = ids[cuts[at] : cuts[at + 1]]
            first, n = since[own], since[own + 1] - since[own]
            places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(owner[places], minlength=len(sets))
            near = common[rest] >= least * (sizes[at] + sizes[rest] - common[rest]) - 1e-9
            for x in rest[near]:
                yield at, x
            queue.extend(rest[near])
            rest = rest[~near]


def _meetings(nodes: DataFrame, least: float, most: int, shingles: int) -> DataFrame:
    """``(g, id)``: groups in which any two rows of ``nodes (id, n, bands)`` meet that share a band and may be similar.

    Similar sets differ in size by a factor of ``least`` at most, so a key with
    over ``most`` rows or ``shingles`` shingles is first told apart by classes of
    size, each row in its own and the next lower one. A class still too large
    is dealt into parts, and every two parts meet as a group: no pair is lost.
    """
    keyed = stored(nodes.select("id", "n", F.posexplode("bands").alias("band", "key")))
    total = (F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum"))
    large = (F.col("rows") > most) | (F.col("sum") > shingles)
    sized = keyed.groupBy("band", "key").agg(*total).filter("rows > 1")
    met = keyed.join(sized, ["band", "key"])
    rank = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(-1.001 * float(np.log(least)))).cast("int")
    classed = met.filter(large).select("id", "n", "band", "key", F.explode(F.array(rank, rank - 1)).alias("class"))
    classes = classed.groupBy("band", "key", "class").agg(*total).filter("rows > 1")
    parts = F.when(large, F.greatest(F.lit(2), F.ceil(2 * F.col("rows") / most), F.ceil(2 * F.col("sum") / shingles))).otherwise(1).cast("int")
    dealt = classed.join(classes, ["band", "key", "class"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(others, lambda x: F.struct(F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j"))))
    small = met.filter(~large).select("band", "key", F.lit(None).cast("int").alias("class"), F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")).alias("pair"), "id")
    all_ = small.unionAll(dealt.select("band", "key", "class", F.explode(pairs).alias("pair"), "id"))
    lists = all_.groupBy("band", "key", "class", "pair").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1)
    return stored(lists.select("ids").distinct().select(F.sha2(F.array_join("ids", ","), 256).alias("g"), F.explode("ids").alias("id")))


def similar_links(nodes: DataFrame, docs: DataFrame, k: int, least: float, most: int = 4096, shingles: int = SHINGLES) -> DataFrame:
    """Edges ``(a, b)`` that connect rows of ``nodes (id, n, bands, doc_id, tk)`` of similarity ``least`` or more that share a band.

    The texts of ``docs (doc_id, tk, text)`` follow for rows with a possible
    partner; similarity is that of the whole shingle sets.
    """
    lists = _meetings(nodes.select("id", "n", "bands"), least, most, shingles)

    @F.pandas_udf("binary")
    def hashes(s: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, k).tobytes() for x in s], dtype=object)

    wanted = lists.select("id").distinct().join(nodes.select("id", "doc_id", "tk"), "id")
    sets = docs.join(wanted, ["doc_id", "tk"]).dropDuplicates(["id"]).select("id", hashes("text").alias("s"))
    groups = lists.join(sets, "id").groupBy("g").agg(F.collect_list(F.struct("id", "s")).alias("m")).select("m.id", "m.s")

    def walk(batches):
        for pdf in batches:
            a, b = [], []
            for ids, s in zip(pdf["id"], pdf["s"], strict=True):
                order = np.argsort(ids, kind="stable")
                ids = np.asarray(ids)[order]
                for i, j in _spanning_similar([np.frombuffer(s[x], dtype=np.uint64) for x in order], least):
                    a.append(ids[i])
                    b.append(ids[j])
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    bound_batches(docs.sparkSession)
    return groups.mapInPandas(walk, "a long, b long")


def simhash_links(nodes: DataFrame, radius: int = 3, blocks: int = 6, most: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` that connect rows of ``nodes (id, fp)`` within ``radius`` bits; fingerprints may repeat."""
    heads = stored(nodes.groupBy("fp").agg(F.min("id").alias("a")))
    same = nodes.select("id", "fp").join(heads, "fp").filter("id <> a").select("a", F.col("id").alias("b"))
    return same.unionAll(links(heads.select(F.col("a").alias("id"), "fp"), radius, blocks, most))


def _grouped(docs: DataFrame, k: int, least: float, most: int, shingles: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, tk, h)`` of the rows of ``docs (doc_id, text)`` with an id, and ``(h, first)``: the first place ``(doc_id, tk)`` of each shingle set's group.

    A place is an id and its text (``tk``, a hash of it), so rows that share an
    id but not their text are told apart.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("h binary, n long, fp long, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(x, k) for x in texts]
        fps = np.array([simhash([s]) for s in sets], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"h": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "fp": fps, "bands": [band_keys(s) for s in sets]})

    docs = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tk"), "text")
    each = stored(docs.select("doc_id", "tk", sketch("text").alias("s")).select("doc_id", "tk", "s.*"))
    merged = each.groupBy("h").agg(F.min(F.struct("doc_id", "tk")).alias("place"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = stored(merged.select(F.monotonically_increasing_id().alias("id"), "h", "n", "fp", "bands", "place.*"))
    found = components(simhash_links(nodes, most=most).unionAll(similar_links(nodes, docs, k, least, most, shingles)))
    named = nodes.join(found, "id", "left").select("h", "doc_id", "tk", F.coalesce("component", "id").alias("component"))
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "tk")).alias("first"))
    return each.select("doc_id", "tk", "h"), stored(named.join(first, "component").select("h", "first"))


def similar_groups(docs: DataFrame, k: int = 5, least: float = 0.8, most: int = 4096, shingles: int = SHINGLES) -> DataFrame:
    """``(doc_id, component_id)`` of each row: groups of texts connected by 3 or fewer differing bits of the SimHash of their ``k``-word shingle sets, or by a similarity of ``least`` or more of these sets.

    SimHash links come by blocks as in ``near_duplicates``; pairs between 3 bits
    and ``least`` come by bands of minima. A group is named by its smallest ``doc_id``. Null, empty and blank texts
    form one group. Rows without ``doc_id`` are left out. An empty table gives
    an empty result.
    """
    each, named = _grouped(docs.select("doc_id", "text"), k, least, most, shingles)
    return each.join(named, "h").select("doc_id", F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each similar group: the one of the smallest ``doc_id``, then of the smallest hash of its text.

    Rows equal in ``doc_id`` and ``text`` become one; rows that share an id but
    not their text are judged each by itself; rows without ``doc_id`` stay.
    Other columns pass through.
    """
    tk = fresh(docs, "tk")
    keyed = docs.withColumn(tk, F.xxhash64("text"))
    _, named = _grouped(docs.select("doc_id", "text"), k, least, 4096, SHINGLES)
    kept = stored(named.select(F.col("first.doc_id").alias("__id"), F.col("first.tk").alias("__tk")).distinct())
    one = keyed.join(kept, (keyed["doc_id"] == kept["__id"]) & (keyed[tk] == kept["__tk"]), "left_semi").dropDuplicates(["doc_id", tk])
    return one.unionAll(keyed.filter("doc_id is null")).select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": (op5, None)}
