"""Benchmark decontamination over a distributed positional inverted index.

The benchmark's windows name the terms worth indexing: the terms of the windows
are counted over the whole corpus, and each window is anchored at its rarest
term. The index stores, for every place of an anchor term in a training text,
document, position and the terms around it. A search meets windows and postings
at the anchor term and intersects the window's other terms with the posting's
neighbourhood at their adjusted offsets: all equal is an exact match; at least
four in five of them, one of the next two rarest included, each within ``slop``
of its offset, is a proximity match. Windows with terms that the corpus lacks
are anchored at their rarest present term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threatscan.llm.common import ascii_lower, fresh, stored, table

#: Words in a window.
SIZE = 10
#: A proximity match may be off by so many places.
SLOP = 3
#: Slots of the filter that spares most tokens the exact join; its size is fixed.
SLOTS = 1 << 20
#: So many terms at most are broadcast; beyond, all tokens are counted and joined by shuffle.
BROADCAST_TERMS = 1_000_000
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), ascii_lower(text)).otherwise(F.lower(text))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(_TERM), F.lit(0))


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS))


def _maybe(slots: list[int]):
    """A test that is true for every term in one of ``slots``: a bitmap of fixed size."""
    bits = [0] * (SLOTS // 32)
    for s in slots:
        bits[s >> 5] |= 1 << (s & 31)
    bitmap = F.from_json(F.lit("[" + ",".join(map(str, bits)) + "]"), "array<bigint>")

    def test(term: Column) -> Column:
        s = _slot(term)
        return F.call_function("bit_get", F.get(bitmap, F.call_function("shiftright", s, F.lit(5)).cast("int")), F.pmod(s, F.lit(32)).cast("int")) == 1

    return test


def _slots(terms_: DataFrame) -> list[int]:
    return [r[0] for r in terms_.select(_slot(F.col("term")).alias("s")).distinct().collect()]  # at most SLOTS numbers


def windows(benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """``(w, n, words)``, one for each different window, and ``(w, item_id)``."""
    items = benchmark.select("item_id", terms(F.col("text")).alias("t")).filter("size(t) > 0")
    n = F.least(F.size("t"), F.lit(size))
    each = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.slice("t", i, n))).alias("words"))
    each = each.withColumn("w", F.sha2(F.array_join("words", " "), 256))
    return each.groupBy("w").agg(F.first("words").alias("words")).withColumn("n", F.size("words")), each.select("w", "item_id").distinct()


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, n)`` over the whole texts of ``docs``, for the terms of ``wanted (term)`` that occur."""
    test = _maybe(_slots(wanted))
    found = docs.select(F.explode(F.filter(terms(F.col("text")), test)).alias("term"))
    if wanted.count() <= BROADCAST_TERMS:
        return found.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(wanted, "term")


def _most(n: Column) -> Column:
    """Four in five of ``n``, rounded up."""
    return F.floor((4 * n + 4) / 5)


def anchored(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with enough terms in the corpus for a match, with ``anchor`` and ``at`` (its offset), and ``next``: up to two other terms, the rarest first, with their offsets."""
    each = wins.select("w", "n", "words", F.posexplode("words").alias("at", "term")).join(counts.withColumnRenamed("n", "freq"), "term")
    by_w = each.groupBy("w", "n", "words").agg(F.array_sort(F.collect_list(F.struct("freq", "term", "at"))).alias("r")).filter(F.size("r") >= _most(F.col("n")))
    rarest = lambda *other: F.filter("r", lambda x: ~x["term"].isin(*other))
    first = by_w.select("*", F.col("r")[0]["term"].alias("anchor"), F.col("r")[0]["at"].alias("at"))
    second = first.withColumn("second", F.get(rarest(F.col("anchor")), F.lit(0)))
    third = second.withColumn("third", F.get(rarest(F.col("anchor"), F.col("second.term")), F.lit(0)))
    return third.select("w", "n", "words", "anchor", "at", F.array_compact(F.array("second", "third")).alias("next"))


def index(docs: DataFrame, anchors: DataFrame, size: int = SIZE, slop: int = SLOP) -> DataFrame:
    """The stored index: ``(rid, doc_id, n_words, term, pos, lead, near)``.

    One row for each place of a term of ``anchors (term)``, with the terms
    around it (``near``, the posting itself after ``lead`` others), and one row
    with a null term for each document.
    """
    test = _maybe(_slots(anchors))
    reach = size - 1 + slop
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", terms(F.col("text")).alias("t"))
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1))), lambda i: F.coalesce(test(F.get("t", i - 1)), F.lit(False)))

    def posting(i):
        since = F.greatest(i - reach, F.lit(1))
        return F.struct(F.get("t", i - 1).alias("term"), (i - 1).alias("pos"), (i - since).alias("lead"), F.slice("t", since, i - since + 1 + reach).alias("near"))

    none = F.from_json(F.lit('{"pos": -1, "lead": 0, "near": []}'), "term string, pos int, lead int, near array<string>")
    out = rows.select("rid", "doc_id", F.size("t").cast("long").alias("n_words"), F.explode(F.concat(F.array(none), F.transform(hits, posting))).alias("p"))
    return stored(out.select("rid", "doc_id", "n_words", "p.*"))


def search(idx: DataFrame, wins: DataFrame, slop: int = SLOP) -> DataFrame:
    """``(rid, w, start, n, exact)`` of each place where a window's terms meet: as a phrase, or else in proximity.

    Both sides are scans dealt out by the anchor, so Spark can split an anchor
    that very many places share.
    """
    lead = F.col("lead") - F.col("at")
    phrase = (F.col("pos") >= F.col("at")) & (F.slice("near", F.greatest(lead, F.lit(0)) + 1, F.col("n")) == F.col("words"))

    def within(term: Column, offset: Column) -> Column:
        since = F.greatest(lead + offset + 1 - slop, F.lit(1))
        return F.array_contains(F.slice("near", since, F.greatest(lead + offset + 1 + slop - since + 1, F.lit(0))), term)

    next_close = F.exists("next", lambda x: within(x["term"], x["at"]))
    most_close = F.size(F.filter(F.transform("words", lambda x, k: within(x, k)), lambda x: x)) >= _most(F.col("n"))
    met = idx.filter("term is not null").join(wins, (F.col("term") == F.col("anchor")) & (phrase | (next_close & most_close)))
    return met.select("rid", "w", (F.col("pos") - F.col("at")).alias("start"), "n", phrase.alias("exact"))


def _found(docs: DataFrame, benchmark: DataFrame, size: int, slop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored index of ``docs (doc_id, text)``, the places of windows in it, and ``(w, item_id)``."""
    wins, items = windows(benchmark.select("item_id", "text"), size)
    wins, items = stored(wins), stored(items)
    counts = stored(term_counts(docs.select("text"), stored(wins.select(F.explode("words").alias("term")).distinct())))
    wins = stored(anchored(wins, counts))
    idx = index(docs.select("doc_id", "text"), wins.select(F.col("anchor").alias("term")).distinct(), size, slop)
    return idx, stored(search(idx, wins, slop)), items


def places(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, slop: int = SLOP) -> DataFrame:
    """``(doc_id, item_id, start, n, exact)``: each place of a window of an item in a document, in words from 0; near ones with the place their anchor gives (below 0 if the window begins before the text)."""
    idx, found, items = _found(docs, benchmark, size, slop)
    ids = idx.filter("term is null").select("rid", "doc_id")
    return found.join(items, "w").join(ids, "rid").select("doc_id", "item_id", "start", "n", "exact")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, slop: int = SLOP) -> DataFrame:
    """A row for each document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, near_items``.

    A document word inside an exact match of a window is hit. Null and empty
    texts have no words; items without words are ignored; a shorter item is one
    window. Rows with equal ids are documents of their own. ``near_items``
    (sorted as strings, comma-joined) are met in proximity but not exactly.
    Empty tables give no hits.
    """
    idx, found, items = _found(docs, benchmark, size, slop)
    spans = found.filter("exact").select("rid", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = F.max("end").over(W.partitionBy("rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    hit = spans.select("rid", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("new")).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    per_item = found.select("rid", "w", "exact").distinct().join(items, "w").groupBy("rid", F.col("item_id").cast("string").alias("item")).agg(F.max("exact").alias("exact"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(kind, F.col("item"))))
    ids = per_item.groupBy("rid").agg(of(F.col("exact")).alias("ids"), of(~F.col("exact")).alias("near"))
    out = idx.filter("term is null").select("rid", "doc_id", "n_words").join(hit, "rid", "left").join(ids, "rid", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near_items"),
        F.coalesce(F.array_join("near", ","), F.lit("")).alias("near_items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without the rows that hold a whole benchmark window. Rows that share a ``doc_id`` but not their text are judged each by itself."""
    tk = fresh(docs, "tk")
    keyed = docs.withColumn(tk, F.xxhash64("text"))
    bad = matches(keyed.select(F.struct("doc_id", F.col(tk).alias("tk")).alias("doc_id"), "text"), benchmark, size).filter("contaminated")
    bad = stored(bad.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.tk").alias("__tk")).distinct())
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["__id"]) & (keyed[tk] == bad["__tk"]), "left_anti").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _near_sql(term: str, offset: str) -> str:
    at = f"o + {offset} + 1"
    return f"list_contains(t[greatest({at} - {SLOP}, 1):greatest({at} + {SLOP}, 0)], {term})"


def matches_sql(of: str = "documents") -> str:
    """CTEs that end in ``matched``: the columns of ``matches`` for ``of``, with ``rid``."""
    return f"""d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_TERMS} AS t FROM {of}),
b AS (SELECT item_id, {_SQL_TERMS} AS t FROM benchmark),
bw AS (SELECT item_id, least(len(t), {SIZE}) AS n, array_to_string(t[i:i + least(len(t), {SIZE}) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(t) - least(len(t), {SIZE}) + 2)) AS i FROM b WHERE len(t) > 0)),
dw AS (SELECT rid, i, n, array_to_string(t[i:i + n - 1], ' ') AS s
  FROM (SELECT rid, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ns ON len(d.t) >= ns.n)),
m AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
cnt AS (SELECT term, count(*) AS f FROM (SELECT unnest(t) AS term FROM d) GROUP BY term),
wt AS (SELECT s, n, words, k, words[k + 1] AS term FROM (SELECT s, n, string_split(s, ' ') AS words, unnest(range(0, n)) AS k FROM (SELECT DISTINCT s, n FROM bw))),
wr AS (SELECT s, n, words, list({{'f': f, 'term': wt.term, 'k': k}} ORDER BY f, wt.term, k) AS r FROM wt JOIN cnt ON wt.term = cnt.term GROUP BY s, n, words HAVING count(*) >= (4 * n + 4) // 5),
wa AS (SELECT s, n, words, r[1].term AS anchor, r[1].k AS k0, list_filter(r, lambda x: x.term <> r[1].term)[1] AS b, r FROM wr),
wb AS (SELECT *, list_filter(r, lambda x: x.term <> anchor AND x.term <> b.term)[1] AS c FROM wa),
cand AS (SELECT rid, t, pos - k0 AS o, s, n, words, b, c FROM (SELECT rid, t, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM d) p JOIN wb ON p.term = wb.anchor),
near AS (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM cand JOIN bw USING (s, n) WHERE ({_near_sql("b.term", "b.k")} OR {_near_sql("c.term", "c.k")})
  AND len(list_filter(range(0, n), lambda k: {_near_sql("words[k + 1]", "k")})) >= (4 * n + 4) // 5),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM m) GROUP BY rid),
nits AS (SELECT rid, count(*) AS n_near_items, string_agg(item_id, ',' ORDER BY item_id) AS near_ids FROM (SELECT * FROM near EXCEPT SELECT rid, item_id::VARCHAR FROM m) GROUP BY rid),
matched AS (SELECT rid, doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items, coalesce(near_ids, '') AS near_items
  FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid) LEFT JOIN nits USING (rid))"""


SQL = f"WITH {matches_sql()} SELECT * EXCLUDE (rid) FROM matched"

QUERIES = {"op8_decontaminate": (op8, SQL)}
