"""URL scan: lexical features, heuristic score, verdict and explanation, all as native expressions.

A scan has no shuffle: the rule lists are constants or broadcast tables, brand
similarity is evaluated inside the row, and features are laid down in a few
projection layers so that no generated method grows too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatscan.functions import text as X
from threatscan.rules import urls as R

#: Scheme, authority, path and query of a URL.
URL_PATTERN = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
INDICATORS = ("is_https", "has_ip", "has_port", "suspicious_tld", "tld_is_country_code", "has_lookalike", "is_free_hosting", "is_shortener", "has_suspicious_path", "consecutive_hyphens", "has_service_prefix", "has_leetspeak", "brand_impersonation", "has_homograph", "has_urgency_tactics")


def normalized(url: Column) -> Column:
    """Trimmed URL with a scheme; empty for a blank one or one without a host."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.when(u == "", "").when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("http://"), u))
    return F.when(F.regexp_extract(u, URL_PATTERN, 2) == "", "").otherwise(u)


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, URL_PATTERN, n)


def reject_reason(url: Column) -> Column:
    """Why a URL is not scanned; null if it is."""
    return F.when(F.length(F.coalesce(url, F.lit(""))) < 4, "too_short").when(normalized(url) == "", "invalid_url")


def split_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``netloc``, ``path``, ``query``, ``host``, ``base_domain`` and ``tld`` of its normalised URL, in lower case."""
    out = df.withColumns({"netloc": F.lower(part(F.col(url), 2)), "path": F.lower(part(F.col(url), 3)), "query": F.lower(part(F.col(url), 4))})
    labels = F.split("netloc", r"\.")
    return out.withColumns(
        {
            "host": F.substring_index("netloc", ":", 1),
            "base_domain": F.when(F.contains("netloc", F.lit(".")), F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("netloc")),
            "tld": F.when(F.contains("netloc", F.lit(".")), F.concat(F.lit("."), F.element_at(labels, -1))).otherwise(""),
        }
    )


def registered_domain(df: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``registered_domain``: the longest entry of ``suffixes (suffix)`` that the host ends with, and one label more.

    ``co.uk`` is an entry; ``*.ck`` stands for every label before ``ck``, and
    ``!www.ck`` is an exception to it. A host that no entry fits has its last
    label as suffix; a host that is itself a suffix stays as it is; null URLs
    stay null. Each different host meets the table once, by its own endings, at
    most three keys for each label.
    """
    named = df.withColumn("__host", F.lower(F.substring_index(part(F.col(url), 2), ":", 1)))
    labels = F.split("__host", r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    # (key of the table, labels of the suffix if the key is there, rank)
    keys = F.flatten(
        F.transform(
            ends,
            lambda e, k: F.array(
                F.struct(e.alias("suffix"), (k + 1).alias("n"), F.lit(0).alias("exception")),
                F.struct(F.concat(F.lit("*."), e).alias("suffix"), (k + 2).alias("n"), F.lit(0).alias("exception")),
                F.struct(F.concat(F.lit("!"), e).alias("suffix"), k.alias("n"), F.lit(1).alias("exception")),
            ),
        )
    )
    hosts = named.filter("__host is not null").select("__host").distinct()
    met = hosts.select("__host", F.explode(keys).alias("k")).select("__host", "k.*").filter(F.col("n") <= F.size(F.split("__host", r"\."))).join(suffixes.select("suffix").distinct(), "suffix")
    best = met.groupBy("__host").agg(F.max(F.struct("exception", "n")).alias("b")).select(F.col("__host").alias("__h"), F.col("b.n").alias("__n"))
    out = named.join(best, F.col("__host") == F.col("__h"), "left")
    size = F.coalesce("__n", F.lit(1)) + 1
    return out.withColumn("registered_domain", F.array_join(F.slice(labels, F.greatest(n - size + 1, F.lit(1)), size), ".")).drop("__host", "__h", "__n")


def trusted(df: DataFrame, suffixes: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``df`` with ``trusted``: whether the base domain is a known one. Without ``suffixes`` that is always two labels; with them it is ``registered_domain``, which is added too."""
    if suffixes is None:
        return split_urls(df, url).select(*df.columns, F.col("base_domain").isin(sorted(R.TRUSTED_DOMAINS)).alias("trusted"))
    return registered_domain(df, suffixes, url).withColumn("trusted", F.col("registered_domain").isin(sorted(R.TRUSTED_DOMAINS)))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def count_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Lengths, character counts and ratios of split URLs."""
    u, dom = F.col(url), F.col("netloc")
    n = lambda x: X.count_of(u, x)
    labels = F.split(dom, r"\.")
    out = df.withColumns(
        {
            "url_length": F.length(u), "domain_length": F.length(dom), "path_length": F.length("path"), "query_length": F.length("query"),
            "num_dots": n("."), "num_hyphens": n("-"), "num_underscores": n("_"), "num_slashes": n("/"), "num_question_marks": n("?"),
            "num_equal_signs": n("="), "num_ampersands": n("&"), "num_at_signs": n("@"), "num_digits": F.regexp_count(u, F.lit(r"\p{Nd}")),
            "is_https": _flag(u.startswith("https://")), "has_ip": _flag(dom.rlike(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")),
            "has_port": _flag(F.contains(F.element_at(labels, -1), F.lit(":"))), "num_subdomains": F.greatest(F.size(labels) - 2, F.lit(0)),
            "path_depth": X.count_of(F.col("path"), "/"),
        }
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns(
        {
            "char_diversity": ratio(F.size(F.array_distinct(X.chars(u))), F.col("url_length")),
            "digit_ratio": ratio(F.col("num_digits"), F.col("url_length")),
            "special_char_ratio": ratio(F.col("num_hyphens") + F.col("num_underscores"), F.col("domain_length")),
        }
    )


def lexicon_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Features that look words up in the rule lists."""
    full, dom = F.lower(url), F.col("netloc")
    first = F.substring_index(dom, ".", 1)
    lookalike = X.contains_any(full, R.LOOKALIKES) | X.contains_any(dom, R.TYPOS) | (X.contains_any(dom, R.CRYPTO_BRANDS) & X.contains_any(full, ["login", "verify", "secure"]))
    return df.withColumns(
        {
            "suspicious_tld": _flag(F.col("tld").isin(R.SUSPICIOUS_TLDS)),
            "tld_is_country_code": _flag(F.col("tld").rlike(r"^\.\p{L}{2}$")),
            "keyword_hits": F.size(X.contained(full, R.KEYWORDS)),
            "has_lookalike": _flag(lookalike),
            "is_free_hosting": _flag(X.contains_any(dom, R.FREE_HOSTING)),
            "is_shortener": _flag(X.contains_any(dom, R.SHORTENERS)),
            "has_suspicious_path": _flag(X.contains_any(F.col("path"), R.SUSPICIOUS_PATHS)),
            "consecutive_hyphens": _flag(F.contains(dom, F.lit("--"))),
            "has_service_prefix": _flag(first.startswith("service") & X.contains_any(first, R.SERVICES)),
            "has_leetspeak": _flag(X.leet(dom) != dom),
        }
    )


def entropy_features(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumns({"domain_entropy": X.entropy(F.col("netloc")), "path_entropy": X.entropy(F.col("path")), "url_entropy": X.entropy(F.col(url))})


def best_brand(netloc: Column, full: Column, brands=None) -> Column:
    """``(similarity, brand)`` of the brand a host imitates best: highest similarity, then by name; null if none."""
    name = F.substring_index(netloc, ".", 1)
    decoded = X.leet(name)
    candidates = F.concat(F.array(decoded), F.transform(F.filter(F.split(name, "[-_]"), lambda t: t != ""), X.leet))
    context = F.contains(name, F.lit("-")) | name.rlike(r"\p{Nd}") | X.contains_any(full, R.BRAND_CONTEXT)

    def rate(b):
        inside = (F.contains(name, b) | F.contains(decoded, b)) & context
        most = F.greatest(F.lit(2), F.floor(F.length(b) / 4))
        near = F.array_max(F.transform(candidates, lambda c: F.when(F.levenshtein(c, b).between(F.lit(1), most) & (X.similarity(c, b) >= 0.75), X.similarity(c, b))))
        return F.struct((-F.when(inside, F.lit(1.0)).otherwise(near)).alias("less"), b.alias("brand"))

    found = F.array_min(F.filter(F.transform(X.array_of(brands or R.BRANDS), rate), lambda x: x["less"].isNotNull()))
    return F.when(found.isNotNull(), F.struct((-found["less"]).alias("similarity"), found["brand"].alias("brand")))


def behaviour_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Brand imitation, mixed scripts, urgency and the anomaly score."""
    full, dom = F.lower(url), F.col("netloc")
    scripts = sum(_flag(dom.rlike(f"[{r}]")) for r in (r"A-z", r"Ѐ-ӿ", r"Ͱ-Ͽ"))
    hits = F.size(X.contained(full, R.URGENCY))
    out = df.withColumn("__brand", best_brand(dom, full)).withColumns(
        {
            "brand_impersonation": F.col("__brand").isNotNull().cast("int"),
            "brand": F.coalesce(F.col("__brand.brand"), F.lit("")),
            "brand_similarity": F.coalesce(F.col("__brand.similarity"), F.lit(0.0)),
            "has_homograph": _flag((scripts > 1) | dom.rlike(f"[{R.CONFUSABLES}]")),
            "has_urgency_tactics": (hits > 0).cast("int"),
            "urgency_score": F.when(hits >= 2, F.least(F.lit(100), hits * 40) / 100.0).when(hits == 1, 0.3).otherwise(0.0),
        }
    )
    c = F.col
    points = [
        (c("url_entropy") > 4.8, 1.5), (c("char_diversity") > 0.7, 1.0), (c("digit_ratio") > 0.15, 1.5), (c("num_hyphens") >= 4, 1.0), (c("num_subdomains") >= 4, 1.5),
        ((c("path_length") > 50) & (c("query_length") == 0), 1.0), ((c("is_https") == 0) & (c("keyword_hits") >= 2), 2.0), (c("consecutive_hyphens") == 1, 0.5),
    ]
    total = sum((F.when(test, p).otherwise(0.0) for test, p in points), F.lit(0.0))
    return out.drop("__brand").withColumn("anomaly_score", F.least(F.lit(1.0), total / 10))


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """All features of normalised URLs."""
    return behaviour_features(entropy_features(lexicon_features(count_features(split_urls(df, url), url), url), url), url)


def heuristic_score() -> Column:
    """Additive score of a feature row, from 0 to 100."""
    c = F.col
    on = lambda name, points: F.when(c(name) == 1, points).otherwise(0)
    own = F.substring_index("base_domain", ".", 1)
    hits = c("keyword_hits")
    hosting = F.when(c("is_free_hosting") == 1, F.when(hits >= 2, 45).when(hits >= 1, 35).otherwise(25)).otherwise(0)
    terms = [
        F.when(c("is_https") == 0, 20).otherwise(0), on("has_ip", 35), on("suspicious_tld", 28), F.least(F.lit(25), hits * 8),
        F.when((c("suspicious_tld") == 1) & (hits >= 2), 18).otherwise(0), F.when(own.rlike(r"\p{Nd}"), 30).otherwise(0),
        F.when(X.count_of(c("base_domain"), "-") >= 2, 15).otherwise(0), on("consecutive_hyphens", 20), on("has_service_prefix", 50), on("has_lookalike", 35),
        hosting, on("is_shortener", 55), F.when(c("url_entropy") >= 4.5, 10).otherwise(0), F.when(c("num_subdomains") >= 3, 10).otherwise(0),
        F.when(c("url_length") >= 90, 7).otherwise(0), on("has_leetspeak", 25), (30 * c("brand_similarity")).cast("int") * c("brand_impersonation"),
        on("has_homograph", 40), F.when(c("anomaly_score") >= 0.6, (15 * c("anomaly_score")).cast("int")).otherwise(0), (12 * c("urgency_score")).cast("int"),
    ]
    return F.greatest(F.lit(0), F.least(F.lit(100), sum(terms[1:], terms[0])))


def verdict(score: Column) -> Column:
    return F.when(score >= 70, "Phishing").when(score >= 40, "Suspicious").otherwise("Safe")


def low_risk() -> Column:
    """Plain HTTPS rows without a strong indicator."""
    c = F.col
    strong = (
        (c("has_ip") == 1) | (c("suspicious_tld") == 1) | (c("has_lookalike") == 1) | (c("is_shortener") == 1) | (c("is_free_hosting") == 1)
        | (c("has_port") == 1) | (c("url_entropy") >= 4.8) | (c("num_subdomains") >= 4) | (c("url_length") >= 120)
    )
    return ~strong & (c("is_https") == 1) & (c("keyword_hits") <= 1)


def flags(url: str = "url") -> Column:
    """Findings of a scored row in plain words, in a fixed order."""
    c = F.col
    is1 = lambda name: c(name) == 1
    own = F.substring_index("base_domain", ".", 1)
    named = F.array_join(F.slice(X.contained(F.lower(url), R.FLAG_KEYWORDS), 1, 5), ", ")
    platform = F.coalesce(F.get(X.contained(c("netloc"), R.PLATFORMS), F.lit(0)), F.lit("free hosting"))
    hyphens = X.count_of(c("base_domain"), "-")
    percent = lambda x: F.bround(100 * x).cast("int").cast("string")
    say = lambda *x: F.concat(*(v if isinstance(v, Column) else F.lit(v) for v in x))
    each = [
        F.when(c("is_https") == 0, "no_https"),
        F.when(is1("has_ip"), "ip_host"),
        F.when(is1("has_lookalike") & X.contains_any(c("netloc"), R.CRYPTO_BRANDS), "lookalike_crypto").when(is1("has_lookalike"), "lookalike").when(own.rlike(r"\p{Nd}"), "digit_substitution"),
        F.when(is1("suspicious_tld"), say("suspicious_tld: ", c("tld"))),
        F.when(is1("is_shortener"), "shortener"),
        F.when(is1("is_free_hosting"), say("free_hosting: ", platform)),
        F.when(c("keyword_hits") >= 3, say("many_keywords (", c("keyword_hits").cast("string"), "): ", named)).when(c("keyword_hits") >= 1, say("keywords (", c("keyword_hits").cast("string"), "): ", named)),
        F.when(c("num_subdomains") >= 3, say("deep_subdomains: ", c("num_subdomains").cast("string"))),
        F.when(c("url_entropy") >= 4.5, say("random_url: ", F.format_string("%.2f", c("url_entropy")))),
        F.when(c("url_length") >= 90, say("long_url: ", c("url_length").cast("string"))),
        F.when(is1("has_suspicious_path"), "suspicious_path"),
        F.when(is1("has_port"), "port"),
        F.when(is1("consecutive_hyphens"), "consecutive_hyphens").when(hyphens >= 2, say("hyphens: ", hyphens.cast("string"))),
        F.when(is1("has_service_prefix"), "service_prefix"),
        F.when(is1("has_leetspeak"), "leetspeak"),
        F.when(is1("brand_impersonation"), say("brand_imitation: ", percent(c("brand_similarity")))),
        F.when(is1("has_homograph"), "homograph"),
        F.when(c("anomaly_score") >= 0.6, say("anomaly: ", percent(c("anomaly_score")))),
        F.when(is1("has_urgency_tactics"), say("urgency: ", percent(c("urgency_score")))),
    ]
    found = F.filter(F.array(*each), lambda x: x.isNotNull())
    none = F.when(c("score") >= 70, "model_alert").when(c("score") >= 45, "model_warning").otherwise("clean")
    return F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(none)))[0]


SUMMARY = ("is_https", "has_ip", "suspicious_tld", "num_subdomains", "keyword_hits", "url_entropy", "url_length", "has_typosquatting", "is_shortener", "is_free_hosting", "has_port", "consecutive_hyphens", "has_service_prefix", "has_leetspeak", "brand_impersonation", "brand_similarity", "has_homograph", "anomaly_score", "has_urgency_tactics", "urgency_score")


def typosquatting() -> Column:
    return F.greatest(F.col("has_lookalike"), _flag(F.substring_index(F.col("netloc"), ".", 1).rlike(r"\p{Nd}")))


def summary() -> Column:
    """The features shown with a result, fractions rounded to four places."""
    rounded = {"url_entropy", "brand_similarity", "anomaly_score", "urgency_score"}
    return F.struct(*((typosquatting() if n == "has_typosquatting" else F.bround(n, 4) if n in rounded else F.col(n)).alias(n) for n in SUMMARY))


def explanation() -> Column:
    """Sentences for the verdict of a scored row."""
    c = F.col
    score = c("score").cast("string")
    why = [
        (c("has_ip") == 1, "The host is an IP address, which hides who runs it."),
        (c("suspicious_tld") == 1, "The top-level domain is often used for phishing."),
        (typosquatting() == 1, "The host imitates a known name."),
        (c("keyword_hits") >= 2, "The URL holds several phishing words."),
        (c("has_leetspeak") == 1, "Digits or signs stand for letters."),
        (c("brand_impersonation") == 1, "The host is close to a brand."),
        (c("has_homograph") == 1, "Letters of other scripts look Latin."),
        (c("anomaly_score") >= 0.6, "Its make-up is unusual."),
    ]
    bad = F.concat_ws(" ", F.concat(F.lit("Score "), score, F.lit("/100: phishing, do not open.")), *(F.when(t, s) for t, s in why))
    return F.when(c("verdict") == "Phishing", bad).when(c("verdict") == "Suspicious", F.concat(F.lit("Score "), score, F.lit("/100: suspicious, take care."))).otherwise(F.concat(F.lit("Score "), score, F.lit("/100: safe, no threat found.")))


def scan_urls(df: DataFrame, url: str = "url", model_scores: DataFrame | None = None, trusted=None, run_id: str = "scan") -> DataFrame:
    """Score every URL of ``df``: its columns, the features, ``score``, ``confidence``, ``verdict``, ``status``, ``flags``, ``summary``, ``explanation``, ``scan_id``.

    Rejected URLs are left out (``reject_reason`` tells why). ``model_scores
    (url, prediction_score)`` may raise a score; values that are no numbers are
    ignored. It is joined by URL, broadcast only if Spark finds it small.
    """
    good = df.filter(reject_reason(F.col(url)).isNull()).withColumn(url, normalized(F.col(url)))
    out = features(good, url).withColumn("heuristic_score", heuristic_score())
    if model_scores is not None:
        ml = model_scores.select(F.col("url").alias("__u"), F.expr("try_cast(prediction_score AS int)").alias("__ml")).groupBy("__u").agg(F.max("__ml").alias("__ml"))
        out = out.join(ml, out[url] == F.col("__u"), "left").withColumn("score", F.greatest("heuristic_score", F.coalesce("__ml", "heuristic_score"))).drop("__u", "__ml")
    else:
        out = out.withColumn("score", F.col("heuristic_score"))
    base = F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1)), F.lit(2)), ".")
    is_trusted = base.isin(list(trusted if trusted is not None else R.TRUSTED_DOMAINS))
    out = out.withColumn("score", F.when(is_trusted & (F.col("score") >= 40), F.least("score", F.lit(30))).when(~is_trusted & low_risk() & (F.col("score") >= 70), F.least("score", F.lit(39))).otherwise(F.col("score")))
    out = out.withColumns({"verdict": verdict(F.col("score")), "confidence": F.bround(F.col("score") / 100, 4)})
    return out.withColumns({"status": F.lower("verdict"), "flags": flags(url), "summary": summary(), "explanation": explanation(), "scan_id": F.sha2(F.concat_ws("|", F.col(url), F.lit(run_id)), 256)})


def detection_rate(scored: DataFrame, at: int = 70, warn: int = 45) -> DataFrame:
    """Of labelled bad URLs with scores: how many there are, how many reach ``at``, how many only ``warn``, and the rate."""
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= at).alias("detected"), F.count_if((F.col("score") >= warn) & (F.col("score") < at)).alias("warned"), F.avg((F.col("score") >= at).cast("int")).alias("rate"))
