"""The pipeline on documents of our own with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    clean = {i: "\n".join(line(rng.randint(8, 40)) for _ in range(6)) for i in range(120)}
    bench = [(i, line(25)) for i in range(4)]
    docs = dict(clean)
    docs[200] = docs[3]  # an exact copy
    near = docs[7].split(" ")
    near[len(near) // 2] = "changed"
    docs[201] = " ".join(near).replace("\n", " ")  # a near copy on one line
    docs[202] = docs[9] + "\n" + bench[1][1].upper() + "\n" + line(30)
    passage = line(70)
    for i in (20, 21, 22):
        docs[i] = docs[i] + "\n" + passage
    docs[203] = " ".join(w + "###" for w in line(60).split())
    docs[204] = (line(3) + " ") * 40
    docs[205], docs[206] = None, ""
    at = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, passage, clean


def test_stages(spark, planted):
    at, docs, passage, clean = planted
    df = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}

    kept = stages["quality"](spark, df, at)
    assert kept.columns == df.columns and ids(kept) == set(docs) - {203, 204, 205, 206}
    lines = stages["line_dedup"](spark, df, at)
    text = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == df.columns and set(text) == set(docs)
    assert [i for i, t in text.items() if t and passage in t] == [20]
    assert all(text[i] == clean[i] for i in range(120) if i not in (9, 20, 21, 22))
    one = stages["simhash"](spark, df, at)
    assert one.columns == df.columns and ids(one) >= set(range(120)) and not ids(one) & {200, 201}
    free = stages["decontaminate"](spark, df, at)
    assert free.columns == df.columns and ids(free) == set(docs) - {202}
    assert stages["packing"](spark, df, at).select("doc_id").distinct().count() == len(docs)


def test_run(spark, planted):
    at, docs, _, clean = planted
    out = corpus_pipeline.run(spark, at)
    got = {r.doc_id for r in out.collect()}
    assert got >= set(range(120)) - {9} and not got & {201, 202, 203, 204, 205, 206}
    spans = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert spans <= 1024


def test_empty(spark, planted, tmp_path):
    at, *_ = planted
    spark.read.parquet(f"{at}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Columns called like those that operators add or use inside.
CLASHES = ["n_words", "symbols", "repeats", "kept", "base_failed", "n_lines", "lines_removed", "row", "tk", "spans", "component_id", "n_hit", "contaminated", "piece", "length", "word_chars"]


def test_clashing_columns_pass_untouched(spark, planted):
    at, *_ = planted
    df = spark.read.parquet(f"{at}/documents.parquet").select("*", *(F.concat(F.lit(f"my {c} "), F.col("doc_id")).alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, at)
        assert out.columns == df.columns and out.schema["n_chars"] == df.schema["n_chars"], name
        rows = out.select("doc_id", *CLASHES).collect()
        assert rows and all(r[c] == f"my {c} {r.doc_id}" for r in rows for c in CLASHES), name
    assert corpus_pipeline.packing(spark, df, at).count() > 0


def test_repeated_and_null_rows(spark, planted):
    at, docs, *_ = planted
    df = spark.read.parquet(f"{at}/documents.parquet")
    odd = df.unionAll(df.filter("doc_id = 5")).unionAll(df.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))).unionAll(df.filter("doc_id = 8").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "doc_id": F.lit(900).cast("long")}))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, at).count() > 100, name
    assert stages_of(spark, odd, at)["line_dedup"].count() == odd.count()


def stages_of(spark, df, at):
    return {name: stage(spark, df, at) for name, stage in corpus_pipeline.STAGES[:2]}
