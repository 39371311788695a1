"""Quality rules with adaptive thresholds.

Fixed base rules come first. What passes them feeds one quantile sketch for
each language, source and measure: counts of log-linear buckets (1/16 relative
width), which merge by addition, so a hot source is pre-aggregated in every
task and small groups fall back to their language's merged sketch, then to the
corpus's. A document stays if each measure lies within a fence around its
group's median: ``reach`` times the distance from the median to the nearer tail
quantile. Where most documents have none of a kind of event, that
distance is nothing; then what a single event makes in the group's median
document, from the sketches of sizes, takes its place. No fence is a fixed number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threatscan.llm.common import WORD, let, stored, table

#: measure -> (the size it is a share of, the thousandths of it that a single event makes), or None where it is as fine as the sketch is (1/16).
#: One repeated window of five words marks ten words. Shares in thousandths, word length in hundredths.
MEASURES = {"symbols": ("n_words", 1000), "dup_lines": ("n_lines", 1000), "repeats": ("n_words", 10_000), "word_length": None}
#: Measures whose low values fail too.
BOTH = {"word_length"}
#: Sizes that are sketched beside the measures.
SIZES = ("n_words", "n_lines")
#: The upper tail quantile in hundredths, and how often its distance from the median a fence reaches. Of the distances to
#: both tails the smaller counts: junk on one side of a measure, up to nearly half of a group, moves only its own tail,
#: and the median by less than the clean documents' own spread.
TAIL, REACH = 85, 5
#: Groups with fewer documents use the merged sketch above them.
LEAST_DOCS = 50
_WINDOW = 5


def _windows(words: Column, body) -> Column:
    """``body(i)`` for the start ``i`` (from 1) of every 5-word window."""
    n = F.size(words) - (_WINDOW - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), body))


def _covered(words: Column) -> Column:
    """Words inside a window whose text is found twice or more."""

    def count(s):
        text = F.transform(s, lambda x: x["s"])
        n = F.size(s)
        near = F.arrays_zip(
            s.alias("x"),
            F.concat(F.array(F.lit(None).cast("string")), F.slice(text, 1, n - 1)).alias("p"),
            F.concat(F.slice(text, 2, n), F.array(F.lit(None).cast("string"))).alias("q"),
        )
        twice = F.filter(near, lambda x: (x["x"]["s"] == x["p"]) | (x["x"]["s"] == x["q"]))
        at = F.array_sort(F.transform(twice, lambda x: x["x"]["i"]))
        return let(at, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(_WINDOW), F.coalesce(b - a, F.lit(_WINDOW)))), F.lit(0).cast("long"), lambda t, x: t + x))

    return let(F.sort_array(_windows(words, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(_WINDOW)), " ").alias("s"), i.alias("i")))), count)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, the measures and ``base_failed``.

    Window hashes tell which texts repeat any window; only those are counted,
    by the windows' texts.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumn("__w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("__l", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    w = F.col("__w")
    base = base.withColumn("__h", _windows(w, lambda i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(_WINDOW)))))
    out = base.select(
        *docs.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.coalesce(F.length(F.array_join("__w", "")), F.lit(0)).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__h") > F.size(F.array_distinct("__h")), _covered(w)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )
    n = F.greatest("n_words", F.lit(1))
    return out.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbols": F.floor(1000 * F.col("n_symbols") / n).cast("long"),
            "dup_lines": F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).cast("long"),
            "repeats": F.floor(1000 * F.col("n_repeat_words") / n).cast("long"),
            "word_length": F.floor(100 * F.col("word_chars") / n).cast("long"),
        }
    )


def bucket(v: str) -> Column:
    """Lower end of the log-linear bucket of a count: exact below 16, then 16 buckets for each doubling."""
    return F.expr(f"CASE WHEN {v} < 16 THEN {v} ELSE shiftleft(shiftright({v}, length(bin({v})) - 5), length(bin({v})) - 5) END")


def sketch(measured: DataFrame) -> DataFrame:
    """One row ``(lang, source, measure, bucket, n)`` for each bucket in use; sketches merge by adding ``n``."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in (*MEASURES, *SIZES))))
    return measured.filter("not base_failed").select("lang", "source", each.alias("e")).select("lang", "source", "e.*").groupBy("lang", "source", "measure", bucket("v").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], tail: int = TAIL) -> DataFrame:
    """``n`` and the ``low``, ``mid`` and ``high`` quantiles of each measure after merging sketches by ``keys``."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(F.max("all").alias("n"), at(100 - tail).alias("low"), at(50).alias("mid"), at(tail).alias("high"))


def thresholds(sketches: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS, tail: int = TAIL) -> DataFrame:
    """``(lang, source, low_<measure>, high_<measure>)`` for each group of the corpus."""
    qs = ("low", "mid", "high")
    own = quantiles(sketches, ["lang", "source"], tail)
    lang = quantiles(sketches, ["lang"], tail).select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_m"), *(F.col(c).alias(f"l_{c}") for c in ("n", *qs)))
    corpus = quantiles(sketches, [], tail).select(F.col("measure").alias("c_m"), *(F.col(c).alias(f"c_{c}") for c in qs))
    met = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_m"))).join(corpus, F.col("measure") == F.col("c_m"))
    pick = lambda q: F.when(F.col("n") >= least_docs, F.col(q)).when(F.col("l_n") >= least_docs, F.col(f"l_{q}")).otherwise(F.col(f"c_{q}"))
    met = met.select("lang", "source", "measure", *(pick(q).alias(q) for q in qs))
    wide = met.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(q))).alias(f"{m}_{q}") for m in (*MEASURES, *SIZES) for q in qs))
    fences = []
    for m, event in MEASURES.items():
        mid = F.col(f"{m}_mid")
        one = F.floor(mid / 16) + 1 if event is None else F.floor(F.lit(event[1]) / F.greatest(f"{event[0]}_mid", F.lit(1))) + 1
        spread = reach * F.greatest(F.least(F.col(f"{m}_high") - mid, mid - F.col(f"{m}_low")), one)
        fences += [(mid + spread).cast("long").alias(f"high_{m}"), (mid - spread).cast("long").alias(f"low_{m}")]
    return wide.select("lang", "source", *fences)


def judged(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` joined with its group's fences: adds ``kept``."""
    f = fences.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    met = measured.join(f, measured["lang"].eqNullSafe(f["__lang"]) & measured["source"].eqNullSafe(f["__source"]), "left")
    ok = ~F.col("base_failed")
    for m in MEASURES:
        ok = ok & (F.coalesce(F.col(m) <= F.col(f"high_{m}"), F.lit(True)))
        if m in BOTH:
            ok = ok & (F.coalesce(F.col(m) >= F.col(f"low_{m}"), F.lit(True)))
    return met.select(*measured.columns, ok.alias("kept"))


def quality(docs: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with counts, measures, ``base_failed`` and ``kept``.

    Null text has no words and fails the base rules, as does empty text. Null
    ``lang`` or ``source`` is a group of its own. Rows with equal ids are
    judged each by itself. An empty table gives an empty result. Other columns
    pass through; one named as an added column gives way to it. The measured
    rows are stored once; ties at a fence stay.
    """
    measured = stored(measures(docs.select(F.struct(*docs.columns).alias("__row"), "lang", "source", "text")).drop("text"))
    fences = stored(thresholds(sketch(measured), reach, least_docs))
    out = judged(measured, fences)
    added = [c for c in out.columns if c not in ("__row", "lang", "source")]
    return out.select(*(F.col("__row")[c].alias(c) for c in docs.columns if c not in added), *added)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = stored(measures(docs).drop("text"))
    fences = stored(thresholds(sketch(measured)))
    return judged(measured, fences).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _bucket_sql(v: str) -> str:
    return f"CASE WHEN {v} < 16 THEN {v} ELSE ({v} >> (length(bin({v})) - 5)) << (length(bin({v})) - 5) END"


def quality_sql(of: str = "documents") -> str:
    """CTEs that end in ``judged``: the rows of ``of`` with counts and ``kept``."""
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {_bucket_sql(m)} AS bucket FROM measured WHERE NOT base_failed" for m in (*MEASURES, *SIZES))

    def quant(name: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        at = lambda q: f"min(CASE WHEN 100 * upto >= {q} * total THEN bucket END)"
        return f"""{name}_r AS (SELECT {k}measure, bucket, sum(sum(n)) OVER (PARTITION BY {k}measure ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY {k}measure) AS total FROM sketch GROUP BY {k}measure, bucket),
{name} AS (SELECT {k}measure, max(total) AS n, {at(100 - TAIL)} AS low, {at(50)} AS mid, {at(TAIL)} AS high FROM {name}_r GROUP BY {k}measure)"""

    pick = lambda q: f"CASE WHEN o.n >= {LEAST_DOCS} THEN o.{q} WHEN l.n >= {LEAST_DOCS} THEN l.{q} ELSE c.{q} END AS {q}"
    wide = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {q} END) AS {m}_{q}" for m in (*MEASURES, *SIZES) for q in ("low", "mid", "high"))
    one = {m: f"({m}_mid // 16 + 1)" if e is None else f"({e[1]} // greatest({e[0]}_mid, 1) + 1)" for m, e in MEASURES.items()}
    spread = {m: f"{REACH} * greatest(least({m}_high - {m}_mid, {m}_mid - {m}_low), {one[m]})" for m in MEASURES}
    fences = ", ".join(f"{m}_mid + {spread[m]} AS high_{m}, {m}_mid - {spread[m]} AS low_{m}" for m in MEASURES)
    ok = " AND ".join([f"coalesce({m} <= high_{m}, true)" for m in MEASURES] + [f"coalesce({m} >= low_{m}, true)" for m in BOTH])
    return rf"""src AS (SELECT row_number() OVER () AS rid, d.* FROM {of} d),
ws AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM src),
win AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM ws WHERE len(w) >= 5)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win),
cover AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice WHERE n > 1) GROUP BY rid),
counts AS (SELECT s.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM src s JOIN ws USING (rid) LEFT JOIN cover USING (rid)),
measured AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_length FROM counts),
sketch AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({each}) GROUP BY ALL),
{quant("own", "lang, source")},
{quant("bylang", "lang")},
{quant("corpus", "")},
picked AS (SELECT o.lang, o.source, o.measure, {pick("low")}, {pick("mid")}, {pick("high")}
  FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN corpus c ON o.measure = c.measure),
wide AS (SELECT lang, source, {wide} FROM picked GROUP BY lang, source),
fences AS (SELECT lang, source, {fences} FROM wide),
judged AS (SELECT m.*, NOT base_failed AND {ok} AS kept FROM measured m LEFT JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)"""


SQL = f"""WITH {quality_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

QUERIES = {"op1_quality": (op1, SQL)}
