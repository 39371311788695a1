"""Language identification by word-first backoff.

A word that training texts know is scored by its log frequency in each
language. An unknown word backs off: it is cut into character n-grams of the
longest order with a known one, then of shorter orders down to single letters.
Frequencies come from a bounded sample of labelled documents (``SAMPLE`` for
each language); the model holds every word and n-gram of that sample, by its
64-bit hash, and is broadcast.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatscan.llm.common import bound_batches, fresh, stored, table

#: Labelled documents of each language that the model is fitted on, at most; chosen by a hash of the text.
SAMPLE = 20_000
#: Different values of ``lang`` that are broadcast with their counts, at most.
MOST_LANGS = 10_000
ORDERS = (5, 4, 3, 2, 1)
#: Each order further down counts less.
DISCOUNT = 0.7
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def _grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def features(word: str):
    """``w:word`` and ``n:gram`` for each order ``n``."""
    yield "w:" + word
    for n in ORDERS:
        for g in _grams(word, n):
            yield f"{n}:{g}"


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of ``labelled (text, lang)``: languages, and for each feature its log frequency in each.

    Every language with a word is learned. What a language lacks has half a
    count; the halves of all features of a kind are part of each total, so a
    language with few texts is no likelier for that. Null texts and languages
    are left out. Without any labelled text the model knows no language.
    """
    bound_batches(labelled.sparkSession)
    known = labelled.filter("text is not null and lang is not null").select("text", "lang")
    sizes = stored(known.groupBy("lang").count())
    few = sizes.limit(MOST_LANGS + 1).count() <= MOST_LANGS  # so many rows are broadcast; texts then stay where they are
    share = known.join(F.broadcast(sizes) if few else sizes, "lang").filter(F.pmod(F.xxhash64("text"), F.ceil(F.col("count") / sample)) == 0)

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                total: Counter = Counter()
                for text in texts:
                    total.update(letter_words(text))
                yield pd.DataFrame({"lang": lang, "word": list(total.keys()), "n": list(total.values())})

    def expand(batches):
        for pdf in batches:
            for lang, rows in pdf.groupby("lang"):
                total: dict = {}
                for word, n in zip(rows["word"], rows["n"], strict=True):
                    for f in features(word):
                        total[f] = total.get(f, 0) + n
                yield pd.DataFrame({"lang": lang, "f": list(total.keys()), "n": list(total.values())})

    # words are counted first, so that each is cut into n-grams once
    words = share.select("text", "lang").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(words.mapInPandas(expand, "lang string, f string, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")))
    kind = F.substring("f", 1, 1)
    totals = {(r[0], r[1]): r[2] for r in counted.groupBy("lang", kind.alias("kind")).agg(F.sum("n")).collect()}  # six rows for each language
    different = {r[0]: r[1] for r in counted.select("f").distinct().groupBy(kind.alias("kind")).count().collect()}  # six rows
    langs = sorted({lang for lang, _ in totals})
    kinds = sorted(different)
    # features reach the driver as numbers, in Arrow batches: hash, kind, language, count
    at = lambda names, c: F.array_position(F.array(*(F.lit(x) for x in names)), c) - 1
    none = np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int32), np.empty(0, np.int64)
    if langs:
        rows = counted.select(F.xxhash64("f").alias("h"), at(kinds, kind).cast("tinyint").alias("k"), at(langs, F.col("lang")).cast("int").alias("l"), "n").toArrow()
        h, k, lang_at, n = (rows.column(c).to_numpy() for c in ("h", "k", "l", "n"))
        del rows
    else:
        h, k, lang_at, n = none
    denominator = np.array([[totals.get((lang, kd), 0) + 0.5 * different[kd] for lang in langs] for kd in kinds]).reshape(len(kinds), len(langs))
    hashes, first, row = np.unique(h, return_index=True, return_inverse=True)
    logp = np.log(0.5 / denominator[k[first]]).astype(np.float32) if len(h) else np.empty((0, len(langs)), np.float32)
    logp[row, lang_at] = np.log((n + 0.5) / denominator[k, lang_at]) if len(h) else 0
    return {"langs": langs, "hashes": hashes, "logp": logp}


class _Rows(dict):
    """Row of each word seen in a matrix of scores; a word is scored at first sight."""

    def __init__(self, scorer):
        self.scorer = scorer

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if i >= len(self.scorer.scores):
            self.scorer.scores = np.concatenate((self.scorer.scores, np.empty_like(self.scorer.scores)))
        self.scorer.scores[i] = self.scorer.word(word)
        return i


class Scorer:
    """Scores texts under a model."""

    #: Words kept with their scores.
    MOST = 400_000

    def __init__(self, model: dict):
        self.langs, self.hashes, self.logp = model["langs"], model["hashes"], model["logp"]
        self.scores, self.rows = np.empty((1 << 14, len(self.langs))), _Rows(self)

    def known(self, features: list[str]) -> np.ndarray:
        """Rows of the features that the model has."""
        h = np.fromiter((xxhash.xxh64_intdigest(f.encode(), 42) for f in features), np.uint64, len(features)).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return at[self.hashes[at] == h] if len(self.hashes) else at[:0]

    def word(self, w: str) -> np.ndarray:
        """Log frequency of a known word in each language, or the discounted mean of its longest known n-grams'."""
        known = self.known(["w:" + w])
        if len(known):
            return self.logp[known[0]]
        weight = 1.0
        for n in ORDERS:
            weight *= DISCOUNT
            found = self.known([f"{n}:{g}" for g in _grams(w, n)])
            if len(found):
                return weight * self.logp[found].mean(axis=0, dtype=np.float64)
        return np.zeros(len(self.langs))

    def text(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; ``und`` and 0 without letters or without a model."""
        words = letter_words(text)
        if not words or not self.langs:
            return "und", 0.0
        if len(self.rows) > self.MOST:
            self.rows.clear()
        at = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
        total = self.scores[at].sum(axis=0)
        p = np.exp(total - total.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


_SCORERS: dict[str, Scorer] = {}


def predicted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; other columns pass through and are never read.

    Null texts and texts without letters are ``und`` with score 0. Ties go to
    the first language by name. Whole texts are read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model)  # the features of at most SAMPLE documents of each language

    @F.pandas_udf("lang_pred string, score double")
    def predict(s: pd.Series) -> pd.DataFrame:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        return pd.DataFrame([_SCORERS[name].text(x) for x in s], columns=["lang_pred", "score"])

    rest, p = [c for c in docs.columns if c not in ("lang_pred", "score")], fresh(docs, "__p")
    return docs.select(*rest, predict(F.col(text)).alias(p)).select(*rest, f"{p}.lang_pred", f"{p}.score")


def held_out(folds: int = 5):
    """Documents whose language no model may learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    return predicted(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


QUERIES = {"op3_langid": (op3, None)}
