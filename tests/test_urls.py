"""Scores, features and verdicts of known URLs."""

import math

import pytest
from pyspark.sql import functions as F

from threatscan.functions import text as X
from threatscan.operators import urls as U

# URLs with the least and the highest score they may have, and the verdict.
BOUNDS = [
    ("https://google.com", None, 45, "safe"),
    ("http://paypa1.com/login", 70, None, "phishing"),
    ("https://secure-login.tk/verify", 70, None, "phishing"),
    ("http://bit.ly/abc123", 40, None, "phishing"),
    ("https://dev-environment.example.com", None, 45, "safe"),
    ("web-trezorr-login-x-en.pages.dev", 70, None, None),
    ("web-sso--app-crypto---cdn.webflow.io", 70, None, None),
    ("w3b3-w4ll3t-v3rify.pages.dev", 70, None, None),
    ("secure-acc0unt-xk92jd.com", 45, None, None),
    ("verify-bank-account.shop", 70, None, None),
    ("http://192.168.1.100/login.html", 70, None, None),
    ("auth-portal--secure.onrender.com", 45, None, None),
    ("bitc0in-wallet-secure.xyz", 70, None, None),
    ("gooogle-accounts-verify.com", 45, None, None),
    ("p4yp4l-secure-urgent-verify-now.site", 45, None, None),
    ("un1sw4p-c0nn3ct-w4ll3t.pages.dev", 45, None, None),
    ("auth-verification--portal.onrender.com", 45, None, None),
    ("verify-metamask-wallet-login.netlify.app", 70, None, None),
    ("coinbase-secure-auth-verify.pages.dev", 70, None, None),
]
# Exact scores.
EXACT = {"http://bit.ly/abc123": 75, "https://google.com": 8, "https://secure-login.tk/verify": 70, "http://paypa1.com/login": 100, "http://192.168.1.100/login.html": 100, "https://dev-environment.example.com": 0}


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame([(u,) for u, *_ in BOUNDS], "given string").withColumn("url", F.col("given"))
    return {r.given: r for r in U.scan_urls(df).collect()}


def test_bounds(scanned):
    for url, low, high, status in BOUNDS:
        r = scanned[url]
        assert low is None or r.score >= low, (url, r.score)
        assert high is None or r.score <= high, (url, r.score)
        assert status is None or r.status == status
        assert r.flags and 0 <= r.score <= 100 and r.confidence == r.score / 100


def test_exact_scores(scanned):
    assert {u: scanned[u].score for u in EXACT} == EXACT


def test_normalise_and_reject(spark):
    given = [("  example.com/a ", "http://example.com/a", None), ("", "", "too_short"), (None, "", "too_short"), ("http:///x", "", "invalid_url"), ("HTTP://a.b", "http://HTTP://a.b", None)]
    df = spark.createDataFrame([(a,) for a, *_ in given], "url string").select(U.normalized(F.col("url")).alias("n"), U.reject_reason(F.col("url")).alias("r"))
    assert [(r.n, r.r) for r in df.collect()] == [(b, c) for _, b, c in given]


def test_scalars(spark):
    r = spark.range(1).select(
        X.leet(F.lit("w4ll3t")).alias("leet"),
        X.entropy(F.lit("aabbccdd")).alias("h"),
        X.entropy(F.lit("")).alias("h0"),
        X.entropy(F.lit("a😀b")).alias("h3"),
        X.count_of(F.lit("aaaa"), "aa").alias("n"),
        X.hamming(F.lit(5), F.lit(6)).alias("d"),
        X.digits_only(F.lit(" 12-3 4")).alias("digits"),
        X.printable_ratio(F.lit("ab\x00\x01")).alias("p"),
    ).first()
    assert r.leet == "wallet" and r.h == 2 and r.h0 == 0 and abs(r.h3 - math.log2(3)) < 1e-9
    assert r.n == 2 and r.d == 2 and r.digits == "1234" and r.p == 0.5


def test_sql_functions(spark):
    X.register(spark)
    r = spark.sql("SELECT shannon_entropy('aabbccdd') h, url_part('http://u@h.com:80/a?b=c#d', 'NETLOC') n, url_part('http://h/a?b=c', 'QUERY') q, leet_decode('w4ll3t') l, levenshtein_ratio('gooogle', 'google') s").first()
    assert abs(r.h - 2) < 1e-9 and r.n == "u@h.com:80" and r.q == "b=c" and r.l == "wallet" and abs(r.s - 5 / 6) < 1e-9


def test_brand_homograph_urgency(spark):
    df = spark.createDataFrame([("http://gooogle-verify.com/login",), ("http://аррӏе-login.com",), ("http://verify-now-urgent-action-required.example",)], "url string")
    a, b, c = U.features(df).collect()
    assert a.brand == "google" and a.brand_similarity >= 0.75
    assert b.has_homograph == 1
    assert c.has_urgency_tactics == 1 and c.urgency_score >= 0.3


def test_model_scores_and_trust(spark):
    df = spark.createDataFrame([("http://login.google.com",), ("https://plain.example.com",)], "url string")
    ml = spark.createDataFrame([("http://login.google.com", "99"), ("https://plain.example.com", "80"), ("https://plain.example.com", "x")], "url string, prediction_score string")
    got = {r.url: r.score for r in U.scan_urls(df, model_scores=ml).collect()}
    assert got == {"http://login.google.com": 30, "https://plain.example.com": 39}
