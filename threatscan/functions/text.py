"""Scalar text functions as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Characters read as letters, and what they stand for.
LEET_FROM, LEET_TO = "01345789@$!|+", "oieastbgasilt"
LEET_PAIRS = (("()", "o"), ("[]", "l"))


def array_of(values) -> Column:
    """A constant array of strings."""
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a constant."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


def contains_any(text: Column, parts) -> Column:
    """Whether ``text`` contains one of the constants; give a column, not an expression that is dear to repeat."""
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts), F.lit(False))


def n_contained(text: Column, parts) -> Column:
    """How many of the constants ``text`` contains."""
    return reduce(add, (F.contains(text, F.lit(p)).cast("int") for p in parts), F.lit(0))


def contained(text: Column, parts) -> Column:
    """The constants that ``text`` contains, in their order."""
    return F.filter(array_of(parts), lambda p: F.contains(text, p))


def first_ending(text: Column, ends) -> Column:
    """The first of the endings that ``text`` has, or null."""
    return F.get(F.filter(array_of(ends), lambda p: F.endswith(text, p)), F.lit(0))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters; 0 for empty text. Counts come from runs of the sorted characters, so the cost grows as the length."""
    sorted_ = F.array_sort(chars(text))
    n = F.length(text)

    def of(s):
        ends = F.filter(F.transform(s, lambda c, i: F.when(F.coalesce(F.get(s, i + 1) != c, F.lit(True)), i + 1)), lambda x: x.isNotNull())
        return F.transform(F.array(ends), lambda e: F.aggregate(F.transform(e, lambda x, k: x - F.coalesce(F.get(e, k - 1), F.lit(0))), F.lit(0.0), lambda t, c: t - (c / n) * F.log2(c / n)))[0]

    return F.when(n > 0, F.transform(F.array(sorted_), of)[0]).otherwise(F.lit(0.0))


def entropy_over(text: Column, bits: float, digits: int | None = None) -> Column:
    """Whether the entropy (rounded to ``digits``) is over ``bits``. So many bits take more different characters than most texts have at all, so it is computed for few."""
    value = entropy(text) if digits is None else F.round(entropy(text), digits)
    many = (F.length(text) > 2**bits) & (F.size(F.array_distinct(F.split(text, ""))) > 2**bits)
    return F.coalesce(F.when(many, value > bits), F.lit(False))


def leet(text: Column) -> Column:
    """Text with look-alike digits and signs read as letters, in lower case."""
    out = F.translate(F.lower(text), LEET_FROM, LEET_TO)
    for a, b in LEET_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the length of ``b``."""
    return 1 - F.levenshtein(a, b) / F.length(b)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def salted_hash(text: Column, salt: str, key: str) -> Column:
    """SHA-256 of a value between salt and key: a stable pseudonym."""
    return F.sha2(F.concat_ws(":", F.lit(salt), text, F.lit(key)), 256)


def printable_ratio(text: Column) -> Column:
    """Share of characters that are no control characters; 0 for empty text."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"\P{C}")), F.length(text)), F.lit(0.0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def bits_above_mean(values: Column) -> Column:
    """Average hash: bit k (from the top) of a 64-value array is 1 if the value is above the mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)
    return F.transform(F.array(mean), lambda m: F.aggregate(values, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x.cast("double") > m, 1).otherwise(0).cast("long"))))[0]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


SQL_FUNCTIONS = {
    "shannon_entropy": "(s STRING) RETURNS DOUBLE RETURN CASE WHEN length(s) = 0 THEN 0D ELSE -aggregate(transform(array_distinct(split(s, '')), c -> (length(s) - length(replace(s, c, ''))) / length(s)), 0D, (t, p) -> t + CASE WHEN p > 0 THEN p * log2(p) ELSE 0D END) END",
    "url_part": "(u STRING, part STRING) RETURNS STRING RETURN regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\\\?([^#]*))?', CASE part WHEN 'SCHEME' THEN 1 WHEN 'NETLOC' THEN 2 WHEN 'PATH' THEN 3 ELSE 4 END)",
    "leet_decode": f"(s STRING) RETURNS STRING RETURN replace(replace(translate(lower(s), '{LEET_FROM}', '{LEET_TO}'), '()', 'o'), '[]', 'l')",
    "levenshtein_ratio": "(a STRING, b STRING) RETURNS DOUBLE RETURN 1 - levenshtein(a, b) / length(b)",
}


def register(spark: SparkSession) -> None:
    """Make the functions available in SQL as temporary functions that Catalyst inlines."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
