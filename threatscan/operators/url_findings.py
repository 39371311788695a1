"""Findings of URLs inside documents; lists by profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatscan.functions import text as X
from threatscan.operators.findings import phrase_hits
from threatscan.operators.urls import part, scan_urls
from threatscan.rules import documents as R

URL = r"""https?://[^\s<>"')\]]+"""


def is_ip_host(netloc: Column) -> Column:
    return F.substring_index(netloc, ":", 1).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def url_findings(url: Column, profile: str) -> Column:
    """The findings of one URL as an array; ``suspicious_url`` may come several times."""
    low = F.lower(url)
    netloc, path = part(low, 2), part(low, 3)
    accented = netloc.rlike("[À-ɏ]")
    more = F.when(accented, "homograph_domain" if profile == "pdf" else "suspicious_url") if profile in ("pdf", "docx", "xlsx") else F.lit(None).cast("string")
    twice = F.when(X.count_of(low, "http") > 1, "suspicious_url") if profile in ("pdf", "docx", "xlsx") else F.lit(None).cast("string")
    return F.array_compact(
        F.array(
            F.when(is_ip_host(netloc), "ip_based_url"),
            F.when(X.contains_any(netloc, R.SHORTENERS[profile]), "shortened_url"),
            F.when(X.first_ending(netloc, R.TLDS[profile]).isNotNull(), "suspicious_tld"),
            F.when(F.contains(url, F.lit("@")), "at_symbol_trick"),
            F.when(low.startswith("http://"), "suspicious_url"),
            F.when(F.length(url) > 200, "suspicious_url"),
            twice,
            F.when(X.contains_any(path, R.LOGIN_PATHS_PDF if profile == "pdf" else R.LOGIN_PATHS), "suspicious_url"),
            more,
        )
    )


def extracted_urls(text: Column, www: bool = False) -> Column:
    """The URLs of a text in order, each once, without trailing punctuation; with ``www``, bare ``www.`` hosts too."""
    pattern = rf"(?i)(?:https?://|www\.)[^\s<>\"')\]]+" if www else rf"(?i){URL}"
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda u: F.regexp_replace(u, r"[).,;]+$", ""))
    if www:
        found = F.transform(found, lambda u: F.when(u.rlike("(?i)^www"), F.concat(F.lit("http://"), u)).otherwise(u))
    return F.array_distinct(F.filter(found, lambda u: F.length(u) > 0))


def is_safe(url: Column, domains=None) -> Column:
    return X.contains_any(F.lower(url), domains or R.SAFE_DOMAINS)


#: So many safe domains at most are searched inside the row.
FEW_DOMAINS = 2000


def without_safe(urls: DataFrame, safe: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL contains no entry of ``safe (domain)``.

    A table of ``FEW_DOMAINS`` rows at most is searched inside the row, once
    their number is known; a larger one is joined by the entries' first
    characters with the different URLs.
    """
    few = [r[0] for r in safe.select("domain").filter("domain is not null").limit(FEW_DOMAINS + 1).collect()]
    if len(few) <= FEW_DOMAINS:
        return urls.filter(~F.coalesce(F.exists(X.array_of(few), lambda d: F.contains(F.lower(url), d)), F.lit(False)))
    hit = phrase_hits(urls.select(F.col(url).alias("__safe")).distinct(), safe.select(F.lit("").alias("category"), F.col("domain").alias("term")), "__safe", "__safe").select("__safe").distinct()
    return urls.join(hit, urls[url] == hit["__safe"], "left_anti")


def url_finding_rows(urls: DataFrame, profile: str, key: str = "id", url: str = "url") -> DataFrame:
    """``(key, ord, finding)`` of a table of URLs; over ten URLs in a file are a finding too for workbooks and texts."""
    each = urls.select(key, F.posexplode(url_findings(F.col(url), profile)).alias("ord", "finding"))
    if profile not in ("docx", "xlsx"):
        return each
    many = urls.groupBy(key).count().filter("count > 10").select(key, F.lit(50).alias("ord"), F.lit("suspicious_url").alias("finding"))
    return each.unionByName(many)


def mismatched_anchor(shown: Column, target: Column) -> Column:
    """A visible text that is a URL of another host than the link's."""
    host = lambda u: F.regexp_replace(part(F.lower(u), 2), r"^www\.", "")
    return F.coalesce(F.trim(shown).rlike("(?i)^https?://") & (host(F.trim(shown)) != host(target)), F.lit(False))


def anchor_finding_rows(links: DataFrame, profile: str, key: str = "id") -> DataFrame:
    """``mismatched_anchor`` for each link ``(key, visible_text, url)`` whose visible text looks like a URL and is not the link's.

    In workbooks and the like that is a text with ``http``; in PDF also one with
    ``www.``, of over ten characters.
    """
    shown, target = F.lower(F.trim("visible_text")), F.lower(F.trim("url"))
    looks = F.contains(shown, F.lit("http"))
    if profile == "pdf":
        looks = (looks | F.contains(shown, F.lit("www."))) & (F.length(shown) > 10)
    return links.filter((F.length(target) > 0) & looks & (shown != target)).select(key, F.lit(60).alias("ord"), F.lit("mismatched_anchor").alias("finding"))


def enriched(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, url, score, verdict)`` of every URL inside texts; each different URL is scanned once and joined back."""
    urls = texts.select(key, F.explode(extracted_urls(F.col(text), True)).alias("url"))
    scored = scan_urls(urls.select("url").distinct()).select("url", "score", "verdict")
    return urls.join(scored, "url").select(key, "url", "score", "verdict")
