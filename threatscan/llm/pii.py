"""Format-preserving pseudonyms for personal data.

Candidates are found by one pattern, then validated by kind (Luhn digit, octet
range, calendar, number plan). A valid value becomes a list of fields, each with
its radix (ten for a digit, 256 for an octet, ...), and a keyed Feistel network
over the fields permutes it within its format: each round adds a keyed hash of
one half to the other, field by field, modulo the radices. The result depends
on the value and the key alone, so equal values stay linked across documents
and nothing has to be gathered or remembered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatscan.llm.common import fresh, let, table

#: The registered query's key. The operator has none of its own: who calls it brings a secret one.
QUERY_KEY = "op9 over the given tables"
ROUNDS = 8
#: kind -> pattern of a candidate. Fixed order: the first that fits names the kind.
KINDS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9_.+%-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\.?\d)",
}
_ANY = "|".join(KINDS.values())
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
_DAYS = (17, 4297)


def _add(own: Column, other: Column, key: str, step: Column, sign: Column) -> Column:
    """Each field of ``own`` plus (or minus) a keyed hash of ``other``, modulo its radix."""
    told = F.sha2(F.concat_ws("|", F.lit(key), step.cast("string"), F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ",")), 512)
    return let(told, lambda h: F.transform(own, lambda x, i: F.struct(F.pmod(x["v"] + sign * F.conv(F.substr(h, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("long"), x["r"]).alias("v"), x["r"].alias("r"))))


def feistel(fields: Column, key: str, back: bool = False) -> Column:
    """``fields`` (array of value and radix) permuted under ``key``; ``back`` undoes it. A single field is shifted by a keyed constant."""
    half = F.floor(F.size(fields) / 2).cast("int")
    start = F.struct(F.slice(fields, F.lit(1), half).alias("a"), F.slice(fields, half + 1, F.size(fields)).alias("b"))
    sign = F.lit(-1 if back else 1).cast("long")
    rounds = F.array(*(F.lit(i) for i in (range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1))))
    even = lambda s, i: F.struct(_add(s["a"], s["b"], key, i, sign).alias("a"), s["b"].alias("b"))
    odd = lambda s, i: F.struct(s["a"].alias("a"), _add(s["b"], s["a"], key, i, sign).alias("b"))
    done = F.aggregate(rounds, start, lambda s, i: F.when(i % 2 == 0, even(s, i)).otherwise(odd(s, i)))
    return let(done, lambda d: F.transform(F.concat(d["a"], d["b"]), lambda x: x["v"]))


def _field(v: Column, r) -> Column:
    return F.struct(v.cast("long").alias("v"), (r if isinstance(r, Column) else F.lit(r)).cast("long").alias("r"))


def _characters(text: Column, fixed: Column, key: str, back: bool, hexa: bool = False) -> Column:
    """Digits and letters of ``text`` permuted, each among its like; the first ``fixed`` characters and all others stay."""
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    code = lambda c: F.ascii(c["c"])
    if hexa:
        of = lambda c: _field(F.conv(c["c"], 16, 10), 16)
        moves = F.filter(chars, lambda c: c["c"] != "")
    else:
        of = lambda c: F.when(code(c) < 58, _field(code(c) - 48, 10)).when(code(c) < 91, _field(code(c) - 65, 26)).otherwise(_field(code(c) - 97, 26))
        moves = F.filter(chars, lambda c: (c["i"] >= fixed) & c["c"].rlike("^[0-9A-Za-z]$"))

    def put(m):
        new = feistel(F.transform(m, of), key, back)
        if hexa:
            lower = text == F.lower(text)
            shown = F.array_join(F.transform(new, lambda v: F.lower(F.conv(v.cast("string"), 10, 16))), "")
            return F.when(lower, shown).otherwise(F.upper(shown))
        shown = F.zip_with(m, new, lambda c, v: F.when(code(c) < 58, v.cast("string")).when(code(c) < 91, F.char(v + 65)).otherwise(F.char(v + 97)))
        return let(F.map_from_arrays(F.transform(m, lambda c: c["i"]), shown), lambda at: F.array_join(F.transform(chars, lambda c: F.coalesce(at[c["i"]], c["c"])), ""))

    return F.when(F.size(moves) == 0, text).otherwise(let(moves, put))


def _luhn(digits: Column) -> Column:
    """The check digit of a digit string that lacks it."""
    rev = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(rev, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))), F.lit(0), lambda s, x: s + x)
    return F.pmod(-total, F.lit(10))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _parts(m: Column, sep: str) -> Column:
    return F.split(m, sep)


def valid(kind: str, m: Column) -> Column:
    """Whether a candidate of a kind is a value of it."""
    if kind == "ip":
        return m.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    if kind == "date":
        return F.try_to_date(m, "yyyy-MM-dd").isNotNull()
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(13, 19) & d.rlike("[1-9]") & (_luhn(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)).cast("int")))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Fa-f]")
    return F.lit(True)


def pseudonym(kind: str, m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a valid value, itself a valid value of the same format."""
    key = f"{key}|{kind}"
    if kind == "email":
        local = F.substring_index(m, "@", 1)
        return F.concat(_characters(local, F.lit(0), key, back), F.substr(m, F.length(local) + 1))
    if kind == "secret":
        return _characters(m, F.lit(0), key, back, hexa=True)
    if kind == "phone":
        return _characters(m, F.length(F.regexp_extract(m, r"^\+(?:1|\d{1,3}(?=\D)|\d\d)", 0)), key, back)
    if kind == "card":
        body = F.substr(m, F.lit(1), F.length(m) - 1)
        return let(_characters(body, F.lit(0), key, back), lambda b: F.concat(b, _luhn(_digits(b)).cast("string")))
    if kind == "ip":
        return F.array_join(feistel(F.transform(_parts(m, r"\."), lambda x: _field(x, 256)), key, back), ".")
    if kind == "ssn":
        area = lambda a: a.cast("int") - 1 - F.when(a.cast("int") > 666, 1).otherwise(0)
        fields = let(_parts(m, "-"), lambda p: F.array(_field(area(p[0]), 898), _field(p[1].cast("int") - 1, 99), _field(p[2].cast("int") - 1, 9999)))
        return let(feistel(fields, key, back), lambda v: F.format_string("%03d-%02d-%04d", v[0] + 1 + F.when(v[0] >= 665, 1).otherwise(0), v[1] + 1, v[2] + 1))
    if kind == "date":
        day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))
        fields = F.array(_field(F.floor(day / _DAYS[1]), _DAYS[0]), _field(F.pmod(day, F.lit(_DAYS[1])), _DAYS[1]))
        return let(feistel(fields, key, back), lambda v: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (v[0] * _DAYS[1] + v[1]).cast("int")), "yyyy-MM-dd"))
    raise ValueError(kind)


def _kind(m: Column) -> Column:
    """The kind of a match, if it is valid."""
    out = None
    for kind, pattern in KINDS.items():
        fits = m.rlike(f"^(?:{pattern})$")
        out = F.when(fits, F.when(valid(kind, m), F.lit(kind))) if out is None else out.when(fits, F.when(valid(kind, m), F.lit(kind)))
    return out


def pseudonymized(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs`` with personal values of ``text`` replaced, plus ``found``: the kinds replaced, in order.

    Null text stays null with no kinds, empty text empty. Rows are independent,
    so repeated rows and ids get equal results. Values that fail their check
    stay as they are. Other columns pass through; ``found`` gives way to the
    new one. With ``back`` and the same key the originals return. E-mail
    domains and country codes stay readable, as parts of the format.
    """
    if not key:
        raise ValueError("a secret key is needed")
    text = F.col("text")
    some = text.rlike("[@0-9]")
    matches = F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), _kind(m).alias("k")))
    m = fresh(docs, "__m")
    with_m = docs.select("*", F.when(some, matches).alias(m))

    def put(x):
        out = x["m"]
        for kind in KINDS:
            out = F.when(x["k"] == kind, pseudonym(kind, x["m"], key, back)).otherwise(out)
        return out

    new = F.array_join(F.concat(F.zip_with(F.slice(F.split(text, _ANY), F.lit(1), F.size(m)), F.transform(m, put), lambda a, b: F.concat(a, b)), F.array(F.element_at(F.split(text, _ANY), -1))), "")
    kinds = F.coalesce(F.transform(F.filter(m, lambda x: x["k"].isNotNull()), lambda x: x["k"]), F.array().cast("array<string>"))
    done = F.when(F.exists(m, lambda x: x["k"].isNotNull()), new).otherwise(text)
    return with_m.select(*(done.alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "found"), kinds.alias("found"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    count = lambda kind: F.size(F.filter("found", lambda x: x == kind)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.size("found").cast("long").alias("n_found"), "text")


QUERIES = {"op9_pii": (op9, None)}
