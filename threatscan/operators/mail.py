"""E-mail findings: authentication results, impersonated senders, urgency and the fused score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatscan.functions import text as X
from threatscan.rules import documents as R

STATUS = "pass|fail|none|neutral|softfail|temperror|permerror"
ADDRESS = r"[^\s<>,;]+@([^\s<>,;]+)"


def auth_status(headers: Column, mechanism: str) -> Column:
    """The first result of a mechanism in joined Authentication-Results headers; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(headers, rf"(?i){mechanism}=({STATUS})", 1)), F.lit(""))


def received_spf(header: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(header, r"(?i)\b(pass|fail|softfail|neutral|none|temperror|permerror)\b", 1)), F.lit(""))


def domain(address: Column) -> Column:
    """Lower-case domain of the first address of a header; null without one."""
    return F.nullif(F.lower(F.regexp_extract(address, ADDRESS, 1)), F.lit(""))


def display_name(address: Column) -> Column:
    """The name before an address, or its local part."""
    name = F.trim(F.regexp_replace(F.regexp_extract(address, r"^(.*?)<[^<>]*>", 1), '"', ""))
    return F.when(name != "", name).otherwise(F.regexp_extract(address, r"([^\s<>,;@]+)@", 1))


def first_brand(name: Column, brands=None) -> Column:
    """The first brand that a name mentions, with its domains."""
    table = F.array(*(F.struct(F.lit(b).alias("brand"), X.array_of(d).alias("domains")) for b, d in (brands or R.MAIL_BRANDS)))
    return F.get(F.filter(table, lambda x: F.contains(F.lower(name), x["brand"])), F.lit(0))


def header_flags(df: DataFrame) -> DataFrame:
    """``df (auth, spf_header, sender, reply_to)`` with ``spf``, ``dkim``, ``dmarc``, ``header_flags`` and ``header_suspicious``."""
    auth = F.coalesce("auth", F.lit(""))
    out = df.withColumns({"spf": F.coalesce(auth_status(auth, "spf"), received_spf(F.coalesce("spf_header", F.lit("")))), "dkim": auth_status(auth, "dkim"), "dmarc": auth_status(auth, "dmarc")})
    bad = ["fail", "softfail", "permerror", "temperror"]
    flags, suspicious = [], F.lit(False)
    for m in ("spf", "dkim", "dmarc"):
        s = F.col(m)
        flags.append(F.when(s.isNull(), f"{m} missing").when(s.isin(bad), F.concat(F.lit(f"{m} "), s)).when(s.isin("neutral", "none"), F.concat(F.lit(f"{m} inconclusive: "), s)))
        suspicious = suspicious | s.isNull() | s.isin(bad)
    sender, reply = domain(F.col("sender")), domain(F.col("reply_to"))
    spoof = F.coalesce(sender != reply, F.lit(False))
    brand = first_brand(display_name(F.col("sender")))
    misuse = F.coalesce(brand.isNotNull() & ~F.exists(brand["domains"], lambda d: F.contains(sender, d)), F.lit(False))
    flags += [F.when(spoof, F.concat(F.lit("reply-to mismatch: "), sender, F.lit(" / "), reply)), F.when(misuse, F.concat(F.lit("display name mismatch: "), sender))]
    return out.withColumns({"header_flags": F.array_compact(F.array(*flags)), "header_suspicious": suspicious | spoof | misuse})


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def body(text: Column, html: Column) -> Column:
    """The plain body, or the HTML one without tags."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", text).otherwise(strip_tags(F.coalesce(html, F.lit(""))))


def html_ratio(text: Column, html: Column) -> Column:
    """Length of HTML over length of text; infinite for HTML alone, 0 for nothing."""
    t, h = F.length(F.trim(F.coalesce(text, F.lit("")))), F.length(F.trim(F.coalesce(html, F.lit(""))))
    return F.when(t == 0, F.when(h > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(h / F.greatest(t, F.lit(1)))


def urgency(text: Column, lexicon=None) -> Column:
    """Urgent words per word, times 20, at most 1."""
    return _urgency_of(F.lower(F.coalesce(text, F.lit(""))), lexicon)


def _urgency_of(low: Column, lexicon=None) -> Column:
    hits = sum((X.count_of(low, w) for w in (lexicon or R.MAIL_URGENCY)), F.lit(0))
    return F.when(F.trim(low) == "", 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(X.word_count(low), F.lit(1)) * 20))


def urgency_flag(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.2, "moderate")


def fused(probability: Column, suspicious: Column, urgency_: Column, ratio: Column) -> Column:
    """Score from 0 to 100 of the four signals."""
    html = F.when(ratio > 3, 1.0).when(ratio > 1.5, 0.5).otherwise(0.0)
    total = 0.6 * F.coalesce(probability, F.lit(0.5)) + 0.2 * suspicious.cast("int") + 0.15 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), urgency_)) + 0.05 * html
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) * 100).cast("int")


def mail_verdict(score: Column) -> Column:
    return F.when(score >= 70, "PHISHING").when(score >= 40, "SUSPICIOUS").otherwise("SAFE")


def mail_severity(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 40, "MEDIUM").otherwise("LOW")


def scan_mail(mails: DataFrame, probabilities: DataFrame | None = None) -> DataFrame:
    """Scores of ``mails (id, auth, spf_header, sender, reply_to, text_body, html_body)``; ``probabilities (id, p)`` of a model are optional."""
    from threatscan.operators.url_findings import extracted_urls

    out = header_flags(mails)
    out = out.join(probabilities.select("id", F.col("p").alias("__p")), "id", "left") if probabilities is not None else out.withColumn("__p", F.lit(None).cast("double"))
    out = out.withColumn("__low", F.lower(F.coalesce(body(F.col("text_body"), F.col("html_body")), F.lit(""))))
    out = out.withColumns({"urgency": _urgency_of(F.col("__low")), "html_ratio": html_ratio(F.col("text_body"), F.col("html_body")), "urls": F.array_distinct(F.concat(extracted_urls(F.coalesce("text_body", F.lit("")), True), extracted_urls(F.coalesce("html_body", F.lit("")), True)))})
    out = out.withColumn("score", fused(F.col("__p"), F.col("header_suspicious"), F.col("urgency"), F.col("html_ratio"))).drop("__p", "__low")
    return out.withColumns({"verdict": mail_verdict(F.col("score")), "severity": mail_severity(F.col("score")), "urgency_flag": urgency_flag(F.col("urgency"))})


def phishing_model(labelled: DataFrame, features: int = 1 << 16):
    """A fitted tokenizer, hashed TF-IDF and naive Bayes pipeline of ``labelled (text, label)``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), NaiveBayes(labelCol="label")]
    return Pipeline(stages=stages).fit(labelled)


def probability(model, df: DataFrame) -> DataFrame:
    """``df (text, ...)`` with ``p``, the model's probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("p"))
