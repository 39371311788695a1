"""The findings engine: weights, scores, breakdowns and implied findings of any ``(id, ord, finding)`` rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatscan.functions import text as X
from threatscan.functions.tables import stored
from threatscan.rules import documents as R

SCHEMA = "finding string, weight int"
#: So many rows of a lexicon table at most are searched inside the row.
FEW_TERMS = 2000


def weight_table(spark: SparkSession, more: dict | None = None) -> DataFrame:
    """The stock weights as a table, with the user's own in their place."""
    return spark.createDataFrame(list((R.WEIGHTS | (more or {})).items()), SCHEMA)


def weighed(findings: DataFrame, weights: DataFrame) -> DataFrame:
    """Each finding with its weight; unknown ones get the default. Spark broadcasts the weights if they are small."""
    w = weights.select(F.col("finding").alias("__f"), F.col("weight").alias("__w"))
    return findings.join(w, findings["finding"] == F.col("__f"), "left").select(findings["*"], F.coalesce("__w", F.lit(R.DEFAULT_WEIGHT)).alias("weight"))


def severity(weight: Column) -> Column:
    """Of one finding."""
    return F.when(weight >= 40, "critical").when(weight >= 30, "danger").when(weight >= 15, "warning").otherwise("safe")


def label(finding: Column) -> Column:
    return F.initcap(F.replace(finding, F.lit("_"), F.lit(" ")))


def verdict(score: Column) -> Column:
    return F.when(score <= 39, "Safe").when(score <= 69, "Suspicious").otherwise("Phishing")


def risk(score: Column) -> Column:
    return F.when(score <= 39, "LOW").when(score <= 69, "MEDIUM").otherwise("CRITICAL")


def breakdown(weighed_: DataFrame, key: str = "id") -> DataFrame:
    """Count, score and first place of each finding of a document."""
    return weighed_.groupBy(key, "finding").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("score"), F.min("ord").alias("first_ord"))


def document_scores(weighed_: DataFrame, key: str = "id") -> DataFrame:
    """Score, verdict, severity, breakdown by falling score and findings in order, for each document.

    One shuffle of finding counts by document and finding, then of one row for
    each kind of finding; a document's arrays hold at most as many entries as
    there are kinds, except for its list of findings.
    """
    b = F.struct((-F.col("score")).alias("less"), F.col("first_ord"), F.col("finding"), F.col("n"), F.col("score"))
    kinds = breakdown(weighed_, key).groupBy(key).agg(F.sum("score").alias("total"), F.sum("n").alias("total_findings"), F.array_sort(F.collect_list(b)).alias("b"))
    shown = F.transform("b", lambda x: F.struct(x["finding"].alias("finding_type"), label(x["finding"]).alias("label"), x["n"].alias("count"), x["score"].alias("score")))
    out = kinds.select(key, F.least(F.lit(100), F.col("total")).cast("int").alias("score"), "total_findings", shown.alias("breakdown"))
    return out.withColumns({"verdict": verdict(F.col("score")), "severity": risk(F.col("score"))})


def detailed(weighed_: DataFrame, key: str = "id") -> DataFrame:
    """Each document's findings in order with label, severity and detail."""
    one = F.struct("ord", "finding", label(F.col("finding")).alias("label"), severity(F.col("weight")).alias("severity"))
    return weighed_.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("findings"))


def chains(findings: DataFrame, profile: str, key: str = "id", phase: str = "full") -> DataFrame:
    """Findings that others of the same document imply, as ``(key, ord, finding, phase)``; rules in rule order.

    The phase ``full`` looks at all findings; ``compat`` leaves out those that
    are made after the chains in the order of the profile's techniques.
    """
    if phase not in ("full", "compat"):
        raise ValueError(phase)
    seen = findings if phase == "full" else findings.filter(~F.col("finding").isin(R.AFTER_CHAINS.get(profile, [])))
    has = seen.groupBy(key).agg(F.collect_set("finding").alias("has"))  # at most one entry for each kind of finding
    rules = []
    for i, (test, implied) in enumerate(R.CHAINS[profile]):
        ok = F.lit(True)
        for group in test.split(" & "):
            ok = ok & F.arrays_overlap("has", X.array_of(group.split("|")))
        rules.append(F.when(ok, F.struct(F.lit(100_000 + i).alias("ord"), F.lit(implied).alias("finding"))))
    return has.select(key, F.explode(F.array_compact(F.array(*rules))).alias("r")).select(key, "r.ord", "r.finding", F.lit(phase).alias("phase"))


CLAUSES = "profile string, rule int, clause int, finding string, implied string"


def chain_table(spark: SparkSession, phase: str = "full") -> DataFrame:
    """The stock chains as clauses ``(profile, rule, clause, finding, implied)``: a rule holds if each of its clauses has one of its findings. Users add rows of their own."""
    rows = []
    for profile, rules in R.CHAINS.items():
        late = R.AFTER_CHAINS.get(profile, []) if phase == "compat" else []
        for i, (test, implied) in enumerate(rules):
            rows += [(profile, i, k, f if f not in late else None, implied) for k, group in enumerate(test.split(" & ")) for f in group.split("|")]
    return spark.createDataFrame(rows, CLAUSES)


def implied_findings(findings: DataFrame, clauses: DataFrame, key: str = "id") -> DataFrame:
    """``(key, profile, ord, finding)`` that rules given as ``clauses`` imply for ``findings (key, profile, finding)``: relational division.

    A finding meets the clauses it satisfies; a document has a rule if it meets
    as many different clauses as the rule has. Repeated findings count once, in
    each task before the shuffle. A clause of null findings alone never holds;
    null profiles meet no rule. Both tables may have any size.
    """
    rule = ["profile", "rule", "implied"]
    sizes = clauses.groupBy(*rule).agg(F.count_distinct("clause").alias("n"))
    known = findings.select(key, "profile", "finding").distinct()
    each = known.join(clauses.filter("finding is not null"), ["profile", "finding"]).select(key, *rule, "clause").distinct()
    held = each.groupBy(key, *rule).agg(F.count(F.lit(1)).alias("has")).join(sizes, rule).filter("has = n")
    return held.select(key, "profile", (F.lit(100_000) + F.col("rule")).alias("ord"), F.col("implied").alias("finding"))


def as_rows(df: DataFrame, rules: list[tuple[Column, str]], key: str = "id", start: int = 0) -> DataFrame:
    """``(key, ord, finding)`` for a list of (test or count, finding): a count gives as many rows."""
    each = []
    for i, (test, finding) in enumerate(rules):
        each.append(F.array_repeat(F.struct(F.lit(start + i).alias("ord"), F.lit(finding).alias("finding")), F.coalesce(test.cast("int"), F.lit(0))))
    return df.select(key, F.explode(F.flatten(F.array(*each))).alias("r")).select(key, "r.ord", "r.finding")


def phrase_hits(df: DataFrame, lexicon, text: str = "text", key: str = "id") -> DataFrame:
    """``(key, category, term, hits)`` for each phrase that a text contains.

    A list of (category, term) is searched inside the row, without a join, and
    so is a table ``(category, term)`` of ``FEW_TERMS`` rows at most, once their
    number is known. A larger table is searched for by automata, or, if it would
    take many of them, by the runs of letters that its terms lie in.
    """
    if isinstance(lexicon, DataFrame):
        lexicon = stored(lexicon.select("category", "term"))  # read again and again, and maybe dear to make
        few = lexicon.limit(FEW_TERMS + 1).collect()
        if len(few) > FEW_TERMS:
            return _phrase_join(df, lexicon, text, key)
        lexicon = [tuple(r) for r in few]
    lexicon = [(c, t) for c, t in lexicon if t]
    if not lexicon:
        return df.select(key, F.lit("").alias("category"), F.lit("").alias("term"), F.lit(0).alias("hits")).limit(0)
    low = F.col("__low")
    terms = F.array(*(F.when(F.contains(low, F.lit(t)), F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"))) for c, t in lexicon))
    one = F.transform(F.array_compact(terms), lambda x: F.struct(x["category"].alias("category"), x["term"].alias("term"), ((F.length(low) - F.length(F.replace(low, x["term"]))) / F.length(x["term"])).cast("int").alias("hits")))
    return df.select(key, F.lower(F.col(text)).alias("__low")).select(key, F.explode(one).alias("h")).select(key, "h.*")


#: Characters of the terms that one automaton holds; a larger lexicon is searched for shard by shard.
SHARD_CHARS = 1_000_000


def _automaton(terms: dict):
    """A pattern matcher of ``term -> categories``."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for t, categories in terms.items():
        out.add_word(t, (t, categories))
    out.make_automaton()
    return out


def _shard_hits(low: DataFrame, terms: dict, key: str) -> DataFrame:
    """Hits of the terms of one shard in ``low (key, __low)``; each text is read once, whatever the number of terms."""
    held, built = low.sparkSession.sparkContext.broadcast(terms), {}

    @F.pandas_udf("array<struct<category:string,term:string,hits:int>>")
    def found(texts: pd.Series) -> pd.Series:
        if not built:  # once for each Python worker's task
            built["a"] = _automaton(held.value)
        out = []
        for text in texts:
            hits: dict = {}
            for end, (t, categories) in built["a"].iter(text or ""):
                n, upto = hits.get(t, (0, -1))[:2]
                if end - len(t) >= upto:  # occurrences that overlap an earlier one do not count
                    hits[t] = (n + 1, end, categories)
            out.append([{"category": c, "term": t, "hits": n} for t, (n, _, cs) in hits.items() for c in cs])
        return pd.Series(out)

    return low.select(key, F.explode(found("__low")).alias("h")).select(key, "h.*")


#: A lexicon of more shards than this is met by runs: one automaton after the other over all texts grows with the square of what grows in both.
FEW_SHARDS = 2
#: What a run is: a term made of such characters alone lies inside one run of a text.
RUN = r"[\p{L}\p{N}]+"
#: Terms meet runs by so many first characters at most; longer runs than ``PIECE`` are cut for that.
START, PIECE = 32, 1000


def _run_hits(low: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Hits of ``terms (term, categories)``, each of characters of runs alone, in ``low (key, __low)``.

    Every different run of all texts is taken once: its substrings as long as
    the start of some term meet the terms in an equi-join. The terms of a run,
    with their numbers, then join the places of the run. Texts are read once,
    and the work grows as the texts and the lexicon do.
    """
    terms = terms.withColumn("start", F.left("term", F.lit(START)))
    sizes = sorted(r[0] for r in terms.select(F.length("start")).distinct().collect())  # START numbers at most
    if not sizes:
        return low.select(key, F.lit("").alias("category"), F.lit("").alias("term"), F.lit(0).alias("hits")).limit(0)
    # rows of equal keys are told apart by their number, which is stored
    runs = low.withColumn("__row", F.monotonically_increasing_id()).select("__row", key, F.explode(F.regexp_extract_all("__low", F.lit(RUN), F.lit(0))).alias("run"))
    runs = stored(runs.filter(F.length("run") >= sizes[0]))
    at = F.explode(F.sequence(F.lit(1), F.length("run"), F.lit(PIECE)))
    pieces = runs.select("run").distinct().select("run", at.alias("at")).select("run", F.substr("run", "at", F.lit(PIECE + START - 1)).alias("piece"))
    n, none = F.length("piece"), F.array().cast("array<string>")
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr("piece", i, k))).otherwise(none)
    starts = F.array_distinct(F.flatten(F.transform(F.array(*(F.lit(k) for k in sizes)), cut)))
    met = pieces.select("run", F.explode(starts).alias("start")).join(terms, "start").filter(F.contains("run", F.col("term")))
    times = (F.length("run") - F.length(F.replace("run", F.col("term")))) / F.length("term")
    held = met.groupBy("run").agg(F.collect_set(F.struct("term", "categories", times.cast("int").alias("n"))).alias("held"))
    each = runs.join(held, "run").select("__row", key, F.explode("held").alias("h")).select("__row", key, "h.*")
    of = each.groupBy("__row", key, "term").agg(F.sum("n").cast("int").alias("hits"), F.first("categories").alias("categories"))
    return of.select(key, F.explode("categories").alias("category"), "term", "hits")


def _phrase_join(df: DataFrame, lexicon: DataFrame, text: str, key: str) -> DataFrame:
    """``phrase_hits`` for a table of any size.

    Up to ``FEW_SHARDS`` shards of about ``SHARD_CHARS`` characters of terms are
    searched for by multi-pattern automata, one shard after the other: it is
    sent to the tasks, which read the texts where they lie; no text is shuffled
    or copied, and the driver holds one shard at a time. Of a larger lexicon the
    terms of letters and digits alone, which are nearly all in a lexicon of
    words, are met by the runs of the texts; phrases of several words go by
    automata.
    """
    lexicon = lexicon.filter("term <> ''")
    low = df.select(key, F.lower(F.col(text)).alias("__low"))

    def shards(part: DataFrame) -> int:
        return (part.agg(F.sum(F.length("term"))).first()[0] or 0) // SHARD_CHARS + 1

    def by_automata(part: DataFrame, n: int) -> DataFrame:
        def shard(k: int) -> dict:
            of = part.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == k).groupBy("term").agg(F.collect_list("category").alias("c"))
            return {r.term: r.c for r in of.collect()}

        if n == 1:
            return _shard_hits(low, shard(0), key)
        texts = stored(low)
        return reduce(DataFrame.unionAll, [stored(_shard_hits(texts, shard(k), key)) for k in range(n)])

    n = shards(lexicon)
    if n <= FEW_SHARDS:
        return by_automata(lexicon, n)
    inside = F.col("term").rlike(rf"\A{RUN}\z")
    found = _run_hits(low, lexicon.filter(inside).groupBy("term").agg(F.collect_list("category").alias("categories")), key)
    rest = lexicon.filter(~inside)
    return found if rest.isEmpty() else found.unionAll(by_automata(rest, shards(rest)))


#: (finding, category, least hits)
THRESHOLDS = [("urgent_tone_detected", "urgency_phrases", 2), ("financial_terms_detected", "financial_terms", 2), ("credential_harvesting", "credential_harvesting", 1), ("enable_macro_lure", "enable_macro_lures", 1), ("repeated_cta", "download_tricks", 3)]


def phrase_counts(hits: DataFrame, categories: list[str], key: str = "id") -> DataFrame:
    """Hits in each category as columns."""
    return hits.groupBy(key).agg(*(F.sum(F.when(F.col("category") == c, F.col("hits")).otherwise(0)).alias(c) for c in categories))


def phrase_findings(df: DataFrame, profile: str, lexicon=None, text: str = "text", key: str = "id") -> DataFrame:
    """Findings of the phrases of a profile: one for each phrase, and those of the category thresholds. The texts are read once."""
    lexicon = R.phrases(profile) if lexicon is None else lexicon
    categories = sorted({c for _, c, _ in THRESHOLDS})
    sums = [F.sum(F.when(F.col("category") == c, F.col("hits")).otherwise(0)).alias(c) for c in categories]
    counts = phrase_hits(df, lexicon, text, key).groupBy(key).agg(F.count(F.lit(1)).alias("phrases"), F.count_if(F.col("category") == "macro_lure").alias("lures"), *sums)
    rules = [(F.col("phrases"), "phishing_keyword")] + [(F.col(c) >= n, f) for f, c, n in THRESHOLDS if f != "repeated_cta" or profile in ("docx", "xlsx")]
    if profile == "pptx":
        rules.append((F.col("lures"), "enable_macro_lure"))
    return as_rows(counts, rules, key)


ANALYZERS: dict = {}


def analyzer(name: str):
    """Register ``DataFrame -> (id, ord, finding)`` under a name; ``analyzed`` runs any set of them."""

    def put(fn):
        ANALYZERS[name] = fn
        return fn

    return put


def analyzed(inputs: dict[str, DataFrame], names=None) -> DataFrame:
    """The findings of several analyzers as one bag; ``inputs`` has the table of each."""
    out = None
    for n in names or list(inputs):
        rows = ANALYZERS[n](inputs[n]).select("id", "ord", "finding")
        out = rows if out is None else out.unionByName(rows)
    return out
