"""Queries of the URL scan over ``pages``.

The pages' own URLs are harmless, so two of three get a suspicious host or
path that follows from the key; Spark and SQL derive the same strings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threatscan.functions import text as X
from threatscan.operators import urls as U
from threatscan.operators.url_findings import enriched, url_finding_rows, without_safe
from threatscan.plans.catalog import query
from threatscan.rules import urls as R

#: Starts put before a page's path, by page_id modulo their number; none keeps the page's own.
STARTS = [
    None, "http://paypa1-verify.xyz", "https://secure-login.tk/verify", None, "http://bit.ly", "https://web-trezorr-login.pages.dev", None, "http://192.168.1.100:8080/login",
    "https://gooogle-accounts-verify.com", "https://google.com", None, "https://servicepaypal--urgent-act-now.webflow.io", "https://xn.аррӏе-login.com", "https://mail.office.com/account/update/password/secure/login/now/verify/confirm/invoice/statement/2024/11/archive", "https://a.b.c.d.example.org",
]


def page_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    start = F.get(F.array(*(F.lit(s) for s in STARTS)), F.pmod("page_id", F.lit(len(STARTS))).cast("int"))
    return pages.select("page_id", F.coalesce(F.concat(start, F.regexp_extract("url", "//[^/]*(.*)$", 1)), "url").alias("url"))


def _l(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_CASES = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STARTS) if s)
URLS = rf"""u AS (SELECT page_id, coalesce(CASE page_id % {len(STARTS)} {_CASES} END || regexp_extract(url, '//[^/]*(.*)$', 1), url) AS url FROM pages),
p AS (SELECT *, lower(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 2)) AS netloc, lower(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 3)) AS path, lower(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 4)) AS query FROM u),
s AS (SELECT *, split_part(netloc, ':', 1) AS host, array_to_string(string_split(netloc, '.')[-2:], '.') AS base_domain, CASE WHEN contains(netloc, '.') THEN '.' || string_split(netloc, '.')[-1] ELSE '' END AS tld FROM p)"""


def _entropy_sql(e: str) -> str:
    return f"(CASE WHEN length({e}) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({e}, '')), lambda c: ((length({e}) - length(replace({e}, c, ''))) / length({e})) * log2((length({e}) - length(replace({e}, c, ''))) / length({e})))) END)"


def _count(e: str, x: str) -> str:
    return f"((length({e}) - length(replace({e}, '{x}', ''))) // {len(x)})"


def _any(e: str, xs) -> str:
    return f"len(list_filter({_l(xs)}, lambda t: contains({e}, t))) > 0"


def _leet(e: str) -> str:
    return f"replace(replace(translate(lower({e}), '{X.LEET_FROM}', '{X.LEET_TO}'), '()', 'o'), '[]', 'l')"


_NAME = "split_part(netloc, '.', 1)"
_CONTEXT = f"(contains({_NAME}, '-') OR regexp_matches({_NAME}, '[0-9]') OR {_any('lower(url)', R.BRAND_CONTEXT)})"
BRAND = f"""brands AS (SELECT unnest({_l(R.BRANDS)}) AS brand),
cand AS (SELECT page_id, unnest(list_concat([{_leet(_NAME)}], list_transform(list_filter(regexp_split_to_array({_NAME}, '[-_]'), lambda t: t <> ''), lambda t: {_leet('t')}))) AS cand FROM s),
direct AS (SELECT page_id, brand, 1.0::DOUBLE AS sim FROM s, brands WHERE (contains({_NAME}, brand) OR contains({_leet(_NAME)}, brand)) AND {_CONTEXT}),
near AS (SELECT page_id, brand, 1 - levenshtein(cand, brand) / length(brand) AS sim FROM cand, brands WHERE levenshtein(cand, brand) BETWEEN 1 AND greatest(2, length(brand) // 4) AND 1 - levenshtein(cand, brand) / length(brand) >= 0.75),
best AS (SELECT page_id, brand, sim FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY sim DESC, brand) AS rn FROM (SELECT * FROM direct UNION ALL SELECT * FROM near)) WHERE rn = 1)"""
FEATURES = rf"""{URLS}, {BRAND},
f1 AS (SELECT s.*, coalesce(best.brand, '') AS brand, coalesce(sim, 0.0)::DOUBLE AS brand_similarity, (sim IS NOT NULL)::INT AS brand_impersonation,
  length(url) AS url_length, length(netloc) AS domain_length, length(path) AS path_length, length(query) AS query_length,
  {_count('url', '-')} AS num_hyphens, {_count('url', '_')} AS num_underscores, length(regexp_replace(url, '[^0-9]', '', 'g')) AS num_digits,
  starts_with(url, 'https://')::INT AS is_https, regexp_matches(netloc, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}')::INT AS has_ip,
  contains(string_split(netloc, '.')[-1], ':')::INT AS has_port, greatest(len(string_split(netloc, '.')) - 2, 0) AS num_subdomains,
  list_contains({_l(R.SUSPICIOUS_TLDS)}, tld)::INT AS suspicious_tld, len(list_filter({_l(R.KEYWORDS)}, lambda t: contains(lower(url), t))) AS keyword_hits,
  ({_any('lower(url)', R.LOOKALIKES)} OR {_any('netloc', R.TYPOS)} OR ({_any('netloc', R.CRYPTO_BRANDS)} AND {_any('lower(url)', ['login', 'verify', 'secure'])}))::INT AS has_lookalike,
  ({_any('netloc', R.FREE_HOSTING)})::INT AS is_free_hosting, ({_any('netloc', R.SHORTENERS)})::INT AS is_shortener, ({_any('path', R.SUSPICIOUS_PATHS)})::INT AS has_suspicious_path,
  contains(netloc, '--')::INT AS consecutive_hyphens, (starts_with({_NAME}, 'service') AND {_any(_NAME, R.SERVICES)})::INT AS has_service_prefix,
  ({_leet('netloc')} <> netloc)::INT AS has_leetspeak, {_entropy_sql('url')} AS url_entropy, len(list_distinct(string_split(url, ''))) / length(url) AS char_diversity,
  ((regexp_matches(netloc, '[A-z]')::INT + regexp_matches(netloc, '[Ѐ-ӿ]')::INT + regexp_matches(netloc, '[Ͱ-Ͽ]')::INT > 1) OR regexp_matches(netloc, '[{R.CONFUSABLES}]'))::INT AS has_homograph,
  len(list_filter({_l(R.URGENCY)}, lambda t: contains(lower(url), t))) AS urgent FROM s LEFT JOIN best USING (page_id)),
f2 AS (SELECT *, num_digits / url_length AS digit_ratio, (urgent > 0)::INT AS has_urgency_tactics, CASE WHEN urgent >= 2 THEN least(100, urgent * 40) / 100.0 WHEN urgent = 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS urgency_score FROM f1),
f AS (SELECT *, least(1.0, (1.5 * (url_entropy > 4.8)::INT + 1.0 * (char_diversity > 0.7)::INT + 1.5 * (digit_ratio > 0.15)::INT + 1.0 * (num_hyphens >= 4)::INT + 1.5 * (num_subdomains >= 4)::INT + 1.0 * (path_length > 50 AND query_length = 0)::INT + 2.0 * (is_https = 0 AND keyword_hits >= 2)::INT + 0.5 * (consecutive_hyphens = 1)::INT) / 10)::DOUBLE AS anomaly_score FROM f2),
h AS (SELECT *, greatest(0, least(100, CASE WHEN is_https = 0 THEN 20 ELSE 0 END + 35 * has_ip + 28 * suspicious_tld + least(25, keyword_hits * 8) + CASE WHEN suspicious_tld = 1 AND keyword_hits >= 2 THEN 18 ELSE 0 END
  + CASE WHEN regexp_matches(split_part(base_domain, '.', 1), '[0-9]') THEN 30 ELSE 0 END + CASE WHEN {_count('base_domain', '-')} >= 2 THEN 15 ELSE 0 END + 20 * consecutive_hyphens + 50 * has_service_prefix + 35 * has_lookalike
  + is_free_hosting * CASE WHEN keyword_hits >= 2 THEN 45 WHEN keyword_hits >= 1 THEN 35 ELSE 25 END + 55 * is_shortener + CASE WHEN url_entropy >= 4.5 THEN 10 ELSE 0 END + CASE WHEN num_subdomains >= 3 THEN 10 ELSE 0 END
  + CASE WHEN url_length >= 90 THEN 7 ELSE 0 END + 25 * has_leetspeak + trunc(30 * brand_similarity)::INT + 40 * has_homograph + CASE WHEN anomaly_score >= 0.6 THEN trunc(15 * anomaly_score)::INT ELSE 0 END + trunc(12 * urgency_score)::INT))::INT AS heuristic_score,
  list_contains({_l(R.TRUSTED_DOMAINS)}, array_to_string(string_split(host, '.')[-2:], '.')) AS trusted,
  NOT (has_ip = 1 OR suspicious_tld = 1 OR has_lookalike = 1 OR is_shortener = 1 OR is_free_hosting = 1 OR has_port = 1 OR url_entropy >= 4.8 OR num_subdomains >= 4 OR url_length >= 120) AND is_https = 1 AND keyword_hits <= 1 AS low_risk FROM f),
sc AS (SELECT *, CASE WHEN trusted AND heuristic_score >= 40 THEN least(heuristic_score, 30) WHEN NOT trusted AND low_risk AND heuristic_score >= 70 THEN least(heuristic_score, 39) ELSE heuristic_score END AS score FROM h),
scored AS (SELECT *, CASE WHEN score >= 70 THEN 'Phishing' WHEN score >= 40 THEN 'Suspicious' ELSE 'Safe' END AS verdict FROM sc)"""


@query("url_parts", f"WITH {URLS} SELECT page_id, url, netloc, path, query, host, base_domain, tld FROM s")
def url_parts(spark, sf):
    return U.split_urls(page_urls(spark, sf))


_COUNTED = {"num_dots": ".", "num_hyphens": "-", "num_underscores": "_", "num_slashes": "/", "num_question_marks": "?", "num_equal_signs": "=", "num_ampersands": "&", "num_at_signs": "@"}


@query(
    "url_counts",
    rf"WITH {URLS} SELECT page_id, length(url) AS url_length, length(netloc) AS domain_length, length(path) AS path_length, length(query) AS query_length, "
    + ", ".join(f"{_count('url', c)}::INT AS {n}" for n, c in _COUNTED.items())
    + r", length(regexp_replace(url, '[^0-9]', '', 'g')) AS num_digits, starts_with(url, 'https://')::INT AS is_https, regexp_matches(netloc, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')::INT AS has_ip, contains(string_split(netloc, '.')[-1], ':')::INT AS has_port, greatest(len(string_split(netloc, '.')) - 2, 0)::INT AS num_subdomains, "
    + _count("path", "/")
    + "::INT AS path_depth FROM s",
)
def url_counts(spark, sf):
    out = U.count_features(U.split_urls(page_urls(spark, sf)))
    return out.select("page_id", "url_length", "domain_length", "path_length", "query_length", *_COUNTED, "num_digits", "is_https", "has_ip", "has_port", "num_subdomains", "path_depth")


@query("url_ratios", rf"WITH {URLS} SELECT page_id, round(len(list_distinct(string_split(url, ''))) / length(url), 6) AS char_diversity, round(length(regexp_replace(url, '[^0-9]', '', 'g')) / length(url), 6) AS digit_ratio, round(({_count('url', '-')} + {_count('url', '_')}) / length(netloc), 6) AS special_char_ratio FROM s")
def url_ratios(spark, sf):
    out = U.count_features(U.split_urls(page_urls(spark, sf)))
    return out.select("page_id", *(F.round(c, 6).alias(c) for c in ("char_diversity", "digit_ratio", "special_char_ratio")))


@query("url_lexicon", f"WITH {FEATURES} SELECT page_id, suspicious_tld, regexp_matches(tld, '^\\.[a-z]{{2}}$')::INT AS tld_is_country_code, keyword_hits::INT AS keyword_hits, has_lookalike, is_free_hosting, is_shortener, has_suspicious_path, consecutive_hyphens, has_service_prefix, has_leetspeak FROM f")
def url_lexicon(spark, sf):
    out = U.lexicon_features(U.split_urls(page_urls(spark, sf)))
    return out.select("page_id", "suspicious_tld", "tld_is_country_code", "keyword_hits", "has_lookalike", "is_free_hosting", "is_shortener", "has_suspicious_path", "consecutive_hyphens", "has_service_prefix", "has_leetspeak")


@query("url_entropy", f"WITH {URLS} SELECT page_id, round({_entropy_sql('netloc')}, 6) AS domain_entropy, round({_entropy_sql('path')}, 6) AS path_entropy, round({_entropy_sql('url')}, 6) AS url_entropy FROM s")
def url_entropy(spark, sf):
    out = U.entropy_features(U.split_urls(page_urls(spark, sf)))
    return out.select("page_id", *(F.round(c, 6).alias(c) for c in ("domain_entropy", "path_entropy", "url_entropy")))


@query("url_leet", f"WITH {URLS} SELECT page_id, {_leet('netloc')} AS decoded, ({_leet('netloc')} <> netloc) AS changed FROM s")
def url_leet(spark, sf):
    return U.split_urls(page_urls(spark, sf)).select("page_id", X.leet(F.col("netloc")).alias("decoded"), (X.leet(F.col("netloc")) != F.col("netloc")).alias("changed"))


@query("url_brand_fuzzy", f"WITH {URLS}, {BRAND} SELECT page_id, brand, round(sim, 6) AS similarity FROM best")
def url_brand_fuzzy(spark, sf):
    out = U.split_urls(page_urls(spark, sf)).withColumn("b", U.best_brand(F.col("netloc"), F.lower("url"))).filter("b is not null")
    return out.select("page_id", "b.brand", F.round("b.similarity", 6).alias("similarity"))


@query("url_anomaly", f"WITH {FEATURES} SELECT page_id, has_homograph, has_urgency_tactics, round(urgency_score, 4) AS urgency_score, round(anomaly_score, 4) AS anomaly_score FROM f")
def url_anomaly(spark, sf):
    out = U.features(page_urls(spark, sf))
    return out.select("page_id", "has_homograph", "has_urgency_tactics", F.round("urgency_score", 4).alias("urgency_score"), F.round("anomaly_score", 4).alias("anomaly_score"))


@query("url_score", f"WITH {FEATURES} SELECT page_id, url, heuristic_score, score, round_even(score / 100.0, 4)::DOUBLE AS confidence, verdict, lower(verdict) AS status FROM scored")
def url_score(spark, sf):
    return U.scan_urls(page_urls(spark, sf)).select("page_id", "url", "heuristic_score", "score", "confidence", "verdict", "status")


@query(
    "url_model_max",
    f"""WITH {FEATURES}, mm AS (SELECT *, greatest(heuristic_score, coalesce(max(CASE WHEN page_id % 3 = 0 THEN (page_id * 7) % 101 END) OVER (PARTITION BY url), heuristic_score)) AS raised FROM h)
SELECT page_id, CASE WHEN trusted AND raised >= 40 THEN least(raised, 30) WHEN NOT trusted AND low_risk AND raised >= 70 THEN least(raised, 39) ELSE raised END::INT AS score FROM mm""",
)
def url_model_max(spark, sf):
    """Scores raised by a model's, and held back for trusted and plain URLs."""
    df = page_urls(spark, sf)
    ml = df.select("url", F.when(F.col("page_id") % 3 == 0, (F.col("page_id") * 7 % 101).cast("string")).otherwise("n/a").alias("prediction_score"))
    return U.scan_urls(df, model_scores=ml).select("page_id", "score")


_PERCENT = "round_even(100 * {}, 0)::INT"
_NAMED = f"array_to_string(list_filter({_l(R.FLAG_KEYWORDS)}, lambda t: contains(lower(url), t))[1:5], ', ')"
_OWN_DIGIT = r"regexp_matches(split_part(base_domain, '.', 1), '\p{Nd}')"
#: The ordered flags of a scored row, in the order of ``operators.urls.flags``.
_FLAGS = f"""list_filter([CASE WHEN is_https = 0 THEN 'no_https' END, CASE WHEN has_ip = 1 THEN 'ip_host' END,
 CASE WHEN has_lookalike = 1 AND {_any("netloc", R.CRYPTO_BRANDS)} THEN 'lookalike_crypto' WHEN has_lookalike = 1 THEN 'lookalike' WHEN {_OWN_DIGIT} THEN 'digit_substitution' END,
 CASE WHEN suspicious_tld = 1 THEN 'suspicious_tld: ' || tld END, CASE WHEN is_shortener = 1 THEN 'shortener' END,
 CASE WHEN is_free_hosting = 1 THEN 'free_hosting: ' || coalesce(list_filter({_l(R.PLATFORMS)}, lambda t: contains(netloc, t))[1], 'free hosting') END,
 CASE WHEN keyword_hits >= 3 THEN 'many_keywords (' || keyword_hits || '): ' || {_NAMED} WHEN keyword_hits >= 1 THEN 'keywords (' || keyword_hits || '): ' || {_NAMED} END,
 CASE WHEN num_subdomains >= 3 THEN 'deep_subdomains: ' || num_subdomains END, CASE WHEN url_entropy >= 4.5 THEN 'random_url: ' || printf('%.2f', url_entropy) END, CASE WHEN url_length >= 90 THEN 'long_url: ' || url_length END,
 CASE WHEN has_suspicious_path = 1 THEN 'suspicious_path' END, CASE WHEN has_port = 1 THEN 'port' END,
 CASE WHEN consecutive_hyphens = 1 THEN 'consecutive_hyphens' WHEN {_count("base_domain", "-")} >= 2 THEN 'hyphens: ' || {_count("base_domain", "-")} END,
 CASE WHEN has_service_prefix = 1 THEN 'service_prefix' END, CASE WHEN has_leetspeak = 1 THEN 'leetspeak' END, CASE WHEN brand_similarity > 0 THEN 'brand_imitation: ' || {_PERCENT.format("brand_similarity")} END,
 CASE WHEN has_homograph = 1 THEN 'homograph' END, CASE WHEN anomaly_score >= 0.6 THEN 'anomaly: ' || {_PERCENT.format("anomaly_score")} END, CASE WHEN has_urgency_tactics = 1 THEN 'urgency: ' || {_PERCENT.format("urgency_score")} END], lambda x: x IS NOT NULL)"""
_WHY = f"""concat_ws(' ', 'Score ' || score || '/100: phishing, do not open.', CASE WHEN has_ip = 1 THEN 'The host is an IP address, which hides who runs it.' END, CASE WHEN suspicious_tld = 1 THEN 'The top-level domain is often used for phishing.' END,
 CASE WHEN has_lookalike = 1 OR regexp_matches(split_part(netloc, '.', 1), '\\p{{Nd}}') THEN 'The host imitates a known name.' END, CASE WHEN keyword_hits >= 2 THEN 'The URL holds several phishing words.' END, CASE WHEN has_leetspeak = 1 THEN 'Digits or signs stand for letters.' END,
 CASE WHEN brand_similarity > 0 THEN 'The host is close to a brand.' END, CASE WHEN has_homograph = 1 THEN 'Letters of other scripts look Latin.' END, CASE WHEN anomaly_score >= 0.6 THEN 'Its make-up is unusual.' END)"""


@query(
    "url_flags",
    f"""WITH {FEATURES}, fl AS (SELECT *, {_FLAGS} AS flags FROM scored) SELECT page_id, CASE WHEN len(flags) > 0 THEN array_to_string(flags, ' | ') WHEN score >= 70 THEN 'model_alert' WHEN score >= 45 THEN 'model_warning' ELSE 'clean' END AS flags,
CASE verdict WHEN 'Phishing' THEN {_WHY} WHEN 'Suspicious' THEN 'Score ' || score || '/100: suspicious, take care.' ELSE 'Score ' || score || '/100: safe, no threat found.' END AS explanation FROM fl""",
)
def url_flags(spark, sf):
    """The ordered flags and the explanation of each page URL."""
    return U.scan_urls(page_urls(spark, sf)).select("page_id", F.array_join("flags", " | ").alias("flags"), "explanation")


@query("url_flag_counts", f"WITH {FEATURES} SELECT count(*) FILTER (is_https = 0) AS no_https, count(*) FILTER (has_ip = 1) AS ip_host, count(*) FILTER (suspicious_tld = 1) AS tld, count(*) FILTER (keyword_hits >= 3) AS many_keywords, count(*) FILTER (has_homograph = 1) AS homograph FROM scored")
def url_flag_counts(spark, sf):
    flags = U.scan_urls(page_urls(spark, sf)).select("flags")
    n = lambda p: F.count_if(F.exists("flags", lambda f: f.startswith(p)))
    return flags.agg(n("no_https").alias("no_https"), n("ip_host").alias("ip_host"), n("suspicious_tld").alias("tld"), n("many_keywords").alias("many_keywords"), n("homograph").alias("homograph"))


@query("url_verdict_rollup", f"WITH {FEATURES} SELECT is_https, verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM scored GROUP BY ROLLUP (is_https, verdict)")
def url_verdict_rollup(spark, sf):
    return U.scan_urls(page_urls(spark, sf)).rollup("is_https", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("detection_rate", f"WITH {FEATURES} SELECT count(*) AS n, count(*) FILTER (score >= 70) AS detected, count(*) FILTER (score >= 45 AND score < 70) AS warned, round(avg((score >= 70)::INT), 6) AS rate FROM scored WHERE page_id % {len(STARTS)} IN (1, 2, 5, 7)")
def detection_rate(spark, sf):
    bad = U.scan_urls(page_urls(spark, sf)).filter((F.col("page_id") % len(STARTS)).isin(1, 2, 5, 7))
    return U.detection_rate(bad).withColumn("rate", F.round("rate", 6))


@query("top_risk", f"WITH {FEATURES} SELECT page_id, score FROM scored ORDER BY score DESC, page_id LIMIT 25")
def top_risk(spark, sf):
    return U.scan_urls(page_urls(spark, sf)).select("page_id", "score").orderBy(F.desc("score"), "page_id").limit(25)


@query("risk_rank", f"WITH {FEATURES} SELECT page_id, host, score, rank() OVER (PARTITION BY host ORDER BY score DESC) AS rank_in_host, lag(score) OVER (PARTITION BY host ORDER BY page_id) AS before, sum(score) OVER (PARTITION BY host ORDER BY page_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM scored")
def risk_rank(spark, sf):
    from pyspark.sql import Window as W

    h = W.partitionBy("host")
    out = U.scan_urls(page_urls(spark, sf))
    return out.select("page_id", "host", "score", F.rank().over(h.orderBy(F.desc("score"))).alias("rank_in_host"), F.lag("score").over(h.orderBy("page_id")).alias("before"), F.sum("score").over(h.orderBy("page_id").rowsBetween(W.unboundedPreceding, 0)).alias("running"))


@query("trusted_semi", f"WITH {URLS} SELECT page_id FROM s WHERE list_contains({_l(R.TRUSTED_DOMAINS)}, array_to_string(string_split(host, '.')[-2:], '.'))")
def trusted_semi(spark, sf):
    trusted = spark.createDataFrame([(d,) for d in R.TRUSTED_DOMAINS], "domain string")
    base = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    return U.split_urls(page_urls(spark, sf)).join(trusted, base == F.col("domain"), "left_semi").select("page_id")


@query("safe_url_antijoin", f"WITH {URLS} SELECT page_id, url FROM u WHERE NOT ({_any('lower(url)', ['office.com', 'bit.ly', 'example.net'])})")
def safe_url_antijoin(spark, sf):
    return without_safe(page_urls(spark, sf), spark.createDataFrame([("office.com",), ("bit.ly",), ("example.net",)], "domain string"))


def _short(profile):
    from threatscan.rules import documents as D

    return D.SHORTENERS[profile], D.TLDS[profile], D.LOGIN_PATHS


_S, _T, _P = _short("docx")


@query(
    "embedded_url_findings",
    rf"""WITH {URLS}, e AS (SELECT page_id, unnest([CASE WHEN regexp_matches(split_part(netloc, ':', 1), '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') THEN 'ip_based_url' END, CASE WHEN {_any('netloc', _S)} THEN 'shortened_url' END,
CASE WHEN len(list_filter({_l(_T)}, lambda t: ends_with(netloc, t))) > 0 THEN 'suspicious_tld' END, CASE WHEN contains(url, '@') THEN 'at_symbol_trick' END, CASE WHEN starts_with(lower(url), 'http://') THEN 'suspicious_url' END,
CASE WHEN length(url) > 200 THEN 'suspicious_url' END, CASE WHEN {_count('lower(url)', 'http')} > 1 THEN 'suspicious_url' END, CASE WHEN {_any('path', _P)} THEN 'suspicious_url' END, CASE WHEN regexp_matches(netloc, '[À-ɏ]') THEN 'suspicious_url' END]) AS finding FROM s)
SELECT page_id, finding, count(*) AS n FROM e WHERE finding IS NOT NULL GROUP BY ALL""",
)
def embedded_url_findings(spark, sf):
    return url_finding_rows(page_urls(spark, sf), "docx", key="page_id").groupBy("page_id", "finding").agg(F.count(F.lit(1)).alias("n"))


@query("url_enrichment", f"WITH {FEATURES} SELECT page_id, url, score, verdict FROM scored")
def url_enrichment(spark, sf):
    texts = page_urls(spark, sf).select("page_id", F.concat(F.lit("see "), "url", F.lit(". or again "), "url", F.lit(", please")).alias("text"))
    return enriched(texts, "page_id")


#: Public suffixes, with a wildcard and its exception, and what is put behind the hosts of the pages.
_SUFFIXES = ["com", "org", "in", "ac.in", "co.uk", "uk", "*.ck", "!www.ck", "kobe.jp", "jp", "*.kawasaki.jp"]
_TAILS = ["", ".ac.in", ".co.uk", ".ck", ".kobe.jp", ".x.kawasaki.jp", ".unknown"]
_HOSTS = ["google", "paruluniversity", "www", "a"]


@query(
    "url_registered_domain",
    rf"""WITH h AS (SELECT page_id, {_l(_HOSTS)}[1 + (page_id % {len(_HOSTS)})::INT] || CASE WHEN page_id % 3 = 0 THEN '' ELSE '.' || regexp_extract(url, '^https?://([^/?#]*)', 1) END || {_l(_TAILS)}[1 + (page_id % {len(_TAILS)})::INT] AS host FROM pages),
s AS (SELECT unnest({_l(_SUFFIXES)}) AS suffix), l AS (SELECT page_id, host, string_split(lower(host), '.') AS p, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM h),
e AS (SELECT page_id, host, p, k, array_to_string(p[len(p) - k + 1:], '.') AS tail FROM l),
m AS (SELECT page_id, 0 AS x, k AS n FROM e JOIN s ON s.suffix = tail UNION ALL SELECT page_id, 0, k + 1 FROM e JOIN s ON s.suffix = '*.' || tail WHERE k < len(p) UNION ALL SELECT page_id, 1, k - 1 FROM e JOIN s ON s.suffix = '!' || tail),
b AS (SELECT page_id, (max({{'x': x, 'n': n}})).n AS n FROM m GROUP BY page_id),
r AS (SELECT page_id, p, coalesce(n, 1) + 1 AS n FROM (SELECT DISTINCT page_id, p FROM l) LEFT JOIN b USING (page_id))
SELECT page_id, array_to_string(p[greatest(len(p) - n + 1, 1):], '.') AS registered_domain, array_to_string(p[greatest(len(p) - n + 1, 1):], '.') IN ({", ".join(f"'{d}'" for d in R.TRUSTED_DOMAINS)}) AS trusted FROM r""",
)
def url_registered_domain(spark, sf):
    """Hosts made of the pages' own ones: the registered domain by a table of suffixes, and whether it is a known one."""
    k, at = F.col("page_id"), lambda xs: F.get(X.array_of(xs), F.pmod(F.col("page_id"), F.lit(len(xs))).cast("int"))
    host = F.concat(at(_HOSTS), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("."), U.part(F.col("url"), 2))), at(_TAILS))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat(F.lit("https://"), host, F.lit(":8080/x")).alias("url"))
    suffixes = spark.createDataFrame([(x,) for x in _SUFFIXES], "suffix string")
    return U.trusted(pages, suffixes).select("page_id", "registered_domain", "trusted")
