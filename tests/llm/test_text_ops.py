import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatscan.llm import chat, decontaminate, langid, lm, pii, quality


def test_quality_odd_rows(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, clean + f" tail{i}", "en", "s", "c") for i in range(80)]
    rows += [(100, None, "en", "s", "x"), (101, "", None, None, "x"), (102, " ".join(["x### y%%% z&&&"] * 1) + " " + " ".join(f"a{i}###" for i in range(60)), "en", "s", "x"), (103, "same same same same same " * 20, "en", "t", "x"), (104, "b " * 9, "en", "s", "x"), (104, "b " * 9, "en", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    out = quality.quality(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 86 and all(got[i].kept and not got[i].base_failed for i in range(80))
    assert got[100].base_failed and got[100].n_words == 0 and got[101].base_failed
    assert not got[102].base_failed and not got[102].kept  # symbols beyond its group's fence
    assert got[103].base_failed and got[103].n_repeat_words == 100
    assert quality.quality(df.limit(0)).count() == 0


def brute_repeats(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 5)}
    return len(hit)


def test_repeated_words_match_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, n)) for n in (3, 5, 20, 60)] + ["a b c d e a b c d e", "a a a a a a", "é b  c\td\x0be f"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality.measures(df).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_sketches_merge(spark):
    df = spark.range(2000).select((F.col("id") % 97 * 13).alias("symbols"), *(F.lit(0).alias(m) for m in ("dup_lines", "repeats", "word_length", *quality.SIZES)), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"), F.lit(False).alias("base_failed"))
    whole = quality.quantiles(quality.sketch(df.withColumn("source", F.lit("one"))), ["lang"]).collect()
    parts = quality.quantiles(quality.sketch(df), ["lang"]).collect()
    assert sorted(whole) == sorted(parts)
    p50 = next(r.mid for r in whole if r.measure == "symbols")
    exact = float(np.median([i % 97 * 13 for i in range(2000)]))
    assert abs(p50 - exact) <= exact / 16 + 1


def test_fences_follow_their_groups(spark):
    rng = np.random.default_rng(4)
    word = lambda k: "".join(rng.choice(list("abcdefghij"), k))
    rows = []
    for n in range(600):
        source, size, low, high, marks = (("plain", 200, 3, 8, 0), ("code", 60, 2, 14, int(rng.integers(10, 30))))[n % 2]
        rows.append((n, " ".join([word(int(rng.integers(low, high))) for _ in range(size)] + [f"#{word(3)}" for _ in range(marks)]), "en", source))
    rows += [(1000, " ".join([*(word(5) for _ in range(150)), *(f"#{word(3)}" for _ in range(30))]), "en", "plain"), (1001, " ".join([*(word(6) for _ in range(60)), *(f"#{word(3)}" for _ in range(15))]), "en", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality.stored(quality.measures(df))
    fences = {r.source: r for r in quality.thresholds(quality.sketch(measured)).collect()}
    assert fences["code"].high_symbols > 5 * fences["plain"].high_symbols > 0 and fences["code"].high_word_length != fences["plain"].high_word_length
    got = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    assert not got[1000] and got[1001]  # the same share of symbols fails in one source and not in the other
    assert sum(not k for i, k in got.items() if i < 1000) <= 6


def test_junk_in_one_group_does_not_move_its_fences(spark):
    """From a tenth to two fifths of a group's documents are junk of one kind; none of it stays, and nearly all clean documents do."""
    rng = np.random.default_rng(9)
    word = lambda k: "".join(rng.choice(list("abcdefghij"), k))
    clean = lambda lines=20: "\n".join(" ".join(word(int(rng.integers(3, 8))) for _ in range(8)) for _ in range(lines))
    pairs = lambda: "\n".join(f"{word(6)} {word(6)}" if i % 2 else "again so" for i in range(60))
    passage = lambda: " ".join([clean(110), *["one two three four five six seven eight nine ten eleven twelve"] * 8])
    junk = {"symbols": lambda: clean() + " #" * 40, "word_length": lambda: " ".join(word(30) for _ in range(160)), "dup_lines": pairs, "repeats": passage}
    rows, bad = [], {}
    for kind, make in junk.items():
        for share in (10, 20, 30, 40):
            for n in range(100):
                bad[len(rows)] = n < share
                rows.append((len(rows), make() if n < share else clean(120 if kind == "repeats" else 20), "en", f"{kind}{share}"))
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "source", "kept", "base_failed").collect()
    assert not [r.source for r in out if bad[r.doc_id] and r.kept]
    assert not any(r.base_failed for r in out)  # the fences do it, not the base rules
    assert sum(not r.kept for r in out if not bad[r.doc_id]) <= 5


def test_real_fences_come_from_the_sketches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", "text")
    sketch = quality.stored(quality.sketch(quality.stored(quality.measures(docs).drop("text"))))
    fences = quality.thresholds(sketch).collect()
    for m in quality.MEASURES:
        assert len({r[f"high_{m}"] for r in fences}) > 1, m


def test_decontaminate_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Only three words"), (3, None), (4, "..."), (22, "only THREE words")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x Alpha, beta gamma-delta epsilon zeta eta theta iota kappa lambda y"), (2, None), (3, ""), (4, "only three  words! only three words"), (5, "alpha beta gamma delta epsilon zeta eta theta iota KAPPAÉ"), (5, "only three words"), (6, "alpha beta gamma delta epsilon zeta eta theta iota iota kappa lambda")],
        "doc_id long, text string",
    )
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in decontaminate.matches(docs, bench).collect())
    sha = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert got == [(1, 13, 11, 1, True, sha("1")), (2, 0, 0, 0, False, sha()), (3, 0, 0, 0, False, sha()), (4, 6, 6, 2, True, sha("2", "22")), (5, 3, 3, 2, True, sha("2", "22")), (5, 10, 0, 0, False, sha()), (6, 12, 0, 0, False, sha())]
    near = {r.doc_id: r.n_near_items for r in decontaminate.matches(docs, bench).collect()}
    assert near[6] == 1
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).filter("contaminated").count() == 0
    more = docs.unionAll(spark.createDataFrame([(None, "only three words"), (None, "clean")], docs.schema)).withColumn("tk", F.lit("own"))
    kept = sorted((r.doc_id or 0, r.text) for r in decontaminate.decontaminated(more, bench).collect() if r.text)
    assert [i for i, _ in kept] == [0, 5, 6] and kept[0][1] == "clean" and "KAPPA" in kept[1][1]  # the other row of 5 goes


def test_proximity_matches_equal_the_sql(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(6)
    word = lambda: f"w{min(rng.randrange(400), rng.randrange(400))}"
    bench = [(i, " ".join([word() for _ in range(rng.choice([3, 10, 14]))] + [f"only{i}"] * (i % 3 == 0))) for i in range(12)]
    docs = []
    for n in range(80):
        own = [word() for _ in range(rng.randint(0, 30))]
        p = bench[n % 12][1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(p))
            rng.choice([lambda: p.insert(at, "extra"), lambda: p.__setitem__(at, "other"), lambda: len(p) > 1 and p.pop(at)])()  # noqa: B023
        at = rng.randint(0, len(own))
        docs.append((n, " ".join(own[:at] + p + own[at:])))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(decontaminate.SQL)
    got = decontaminate.op8(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert sum(r.contaminated for r in got) > 10 and sum(r.n_near_items > 0 for r in got) > 10
    at = decontaminate.places(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))).filter("exact").collect()
    texts, items = dict(docs), dict(bench)
    for r in at:
        assert " ".join(texts[r.doc_id].split()[r.start : r.start + r.n]) in items[r.item_id]


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = langid.op3(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] >= 0.98 and 0 <= got[1] <= got[2] <= 1


def test_langid_matches_brute_force(spark):
    import math
    import re
    from collections import Counter

    docs = [(r.doc_id, r.text, r.lang, r.h) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", langid.held_out().alias("h")).collect()]
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, n: list(w) if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    counts: dict = {}
    for _, t, lang, h in docs:
        if not h and lang is not None and t is not None:
            for w in split(t):
                for kind, fs in [("w", [w]), *((n, grams(w, n)) for n in (5, 4, 3, 2, 1))]:
                    counts.setdefault((lang, kind), Counter()).update(fs)
    langs = sorted({lang for lang, _ in counts})
    all_of = {k: set().union(*(counts[lang, k] for lang in langs)) for k in ("w", 5, 4, 3, 2, 1)}
    totals = {key: sum(c.values()) for key, c in counts.items()}
    log = lambda lang, k, f: math.log((counts[lang, k][f] + 0.5) / (totals[lang, k] + 0.5 * len(all_of[k])))

    def word(w):
        if w in all_of["w"]:
            return [log(lang, "w", w) for lang in langs]
        for step, n in enumerate((5, 4, 3, 2, 1), 1):
            found = [g for g in grams(w, n) if g in all_of[n]]
            if found:
                return [0.7**step * sum(log(lang, n, g) for g in found) / len(found) for lang in langs]
        return [0.0] * len(langs)

    model = langid.fit(spark.createDataFrame([(t, lang) for _, t, lang, h in docs if not h], "text string, lang string"))
    got = {r.doc_id: r for r in langid.predicted(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), model).collect()}
    for i, t, _, _ in docs:
        ws = split(t)
        total = [sum(x) for x in zip(*map(word, ws))]
        if not ws:
            assert got[i].lang_pred == "und"
            continue
        p = [math.exp(x - max(total)) for x in total]
        assert got[i].lang_pred == langs[p.index(max(p))] and abs(got[i].score - max(p) / sum(p)) < 1e-3


def test_langid_odd_rows(spark):
    train = spark.createDataFrame([("the cat and the dog", "en")] * 5 + [("le chat et le chien", "fr")] * 5 + [(None, "en"), ("x", None)], "text string, lang string")
    model = langid.fit(train)
    docs = spark.createDataFrame([(1, "The DOG", "?"), (2, "lechien", "?"), (3, None, "?"), (4, "123 !?", "?"), (5, "", "?"), (6, "中文", "?")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "fr" and got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] in ("en", "fr")
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predicted(docs, empty).collect()} == {"und"}


def test_lm_gradients():
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.3, sum(int(np.prod(d)) for _, d in lm.SHAPES_OF)).astype(np.float64)
    inp, start = rng.integers(0, lm.INPUTS, (5, 3)), np.zeros((5, 3), dtype=bool)
    start[0], start[2, 1] = True, True
    cls, within, doc = rng.integers(0, lm.CLASSES, (5, 3)), rng.integers(0, lm.SIZE, (5, 3)), np.zeros((5, 3), dtype=int)
    doc[4, 2] = -1
    h = np.zeros((3, lm.HIDDEN))

    def loss(f):
        p = lm.unpack(f)
        x = p["x"][inp]
        s, out = h, []
        for t in range(5):
            s = s * ~start[t][:, None]
            zr = lm._sigmoid(x[t, :, : 2 * lm.HIDDEN] + s @ p["u"])
            z, r = zr[:, : lm.HIDDEN], zr[:, lm.HIDDEN :]
            s = s + z * (np.tanh(x[t, :, 2 * lm.HIDDEN :] + (r * s) @ p["v"]) - s)
            out.append(s)
        mask = (doc >= 0).ravel()
        return -lm.log_probabilities(p, np.array(out).reshape(-1, lm.HIDDEN)[mask], cls.ravel()[mask], within.ravel()[mask]).mean()

    g, _, n = lm.gradients(lm.unpack(flat), inp, cls, within, doc, start, h)
    assert n == 14
    at = 0
    for name, dims in lm.SHAPES_OF:
        size = int(np.prod(dims))
        big = np.argsort(-np.abs(g[name].ravel()))[:4]
        for i in big:
            up, down = flat.copy(), flat.copy()
            up[at + i] += 1e-5
            down[at + i] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[name].ravel()[i]) < 1e-4
        at += size


def test_lm_words_and_inputs_of_whole_batches():
    odd = ["", None, "  a\tB\x0b\x0c c\r\n", "\xa0x \u2003 X x", "\x1c\x85\u00e9 \u4e2d\u6587 D\u00c9", "   ", "dog Dog cat dog zebra zebra \U0001f600", "cat"]
    upper = {c: c + 32 for c in range(65, 91)}
    plain = [[w.decode() for w in (t or "").translate(upper).encode().split()] for t in odd]
    ws, cuts = lm.words(pa.array(odd, pa.string()))
    ws = ws.to_pylist()
    assert [ws[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] == plain
    distinct = sorted({w for ws in plain for w in ws})
    assert lm.shapes(pa.array(distinct)).tolist() == [lm.shape(w) for w in distinct]

    near = ["dog", "x"] + [f"w{i}" for i in range(lm.FREQUENT)] + ["cat"]  # the last is near, but not frequent
    count, log_tail = np.arange(len(near), 0, -1) + 0.0, np.linspace(1, 2, lm.SHAPES)
    e = lm.Encoder({"near": near, "near_count": count, "log_tail": log_tail})
    for row, ws in zip(e.texts(pa.array(odd, pa.string())).to_pylist(), plain, strict=True):
        rank = [near.index(w) if w in near else -1 for w in ws]
        far = [w for w, r in zip(ws, rank, strict=True) if r < 0]
        assert np.frombuffer(row["tokens"], "<u2").tolist() == [r if 0 <= r < lm.FREQUENT else lm.FREQUENT + lm.shape(w) for w, r in zip(ws, rank, strict=True)]
        assert (row["n_tokens"], row["n_near"]) == (len(ws) + 1, len(ws) - len(far))
        assert dict(zip(row["far"], row["tf"], strict=True)) == {w: far.count(w) for w in far}
        log = [np.log10(count[r] + 0.1) for r in rank if r >= 0]
        tail = [(np.log10(count[r] + 0.1) if r >= 0 else 0) - log_tail[lm.shape(w)] for w, r in zip(ws, rank, strict=True) if not 0 <= r < lm.FREQUENT]
        assert abs(row["near"] - sum(log)) < 1e-9 and abs(row["tail"] - sum(tail)) < 1e-9
    assert len(e.texts(pa.array([], pa.string()))) == 0


def test_lm_sums_of_rows_by_place():
    rng = np.random.default_rng(4)
    at = np.sort(np.concatenate((rng.integers(0, 50, 60), np.full(200, 7), np.full(lm._FEW, 51), np.full(lm._FEW + 1, 52), [59])))
    rows, plain = rng.normal(0, 1, (len(at), 5)), np.zeros((60, 5))
    np.add.at(plain, at, rows)
    assert np.allclose(lm._summed(rows, at, 60), plain)


def test_lm_ended_lanes_are_left_out_of_training(monkeypatch):
    rng, widths, plain = np.random.default_rng(5), [], lm.gradients

    def gradients(p, inp, cls, within, doc, start, h):
        assert (doc >= 0).any(axis=0).all() and len(h) == inp.shape[1]
        widths.append(inp.shape[1])
        return plain(p, inp, cls, within, doc, start, h)

    monkeypatch.setattr(lm, "gradients", gradients)
    texts = [lm.coded(rng.integers(0, lm.END_INPUT, n).astype("<u2").tobytes()) for n in [lm.STEPS * 8] + [20] * 9]
    flat = rng.normal(0, 0.1, sum(int(np.prod(d)) for _, d in lm.SHAPES_OF)).astype(np.float32)
    new, tokens = lm.train(flat, texts, least=1)
    assert widths == [10] + [1] * 8 and tokens == sum(len(x[0]) for x in texts) and np.isfinite(new).all()


def test_lm_probabilities_sum_to_one_and_windows_carry_state():
    rng = np.random.default_rng(2)
    p = lm.unpack(rng.normal(0, 0.3, sum(int(np.prod(d)) for _, d in lm.SHAPES_OF)).astype(np.float32))
    hs = rng.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    learned = sum(float(np.exp(lm.log_probabilities(p, hs, np.array([c]), np.array([w]))[0])) for c in range(lm.GROUPS) for w in range(lm.SIZE))
    others = sum(float(np.exp(lm.log_probabilities(p, hs, np.array([c]), np.array([0]))[0])) for c in range(lm.GROUPS, lm.CLASSES))
    assert abs(learned + others - 1) < 1e-3
    inp, start = rng.integers(0, lm.INPUTS, (150, 2)), np.zeros((150, 2), dtype=bool)
    h = np.zeros((2, lm.HIDDEN), dtype=np.float32)
    whole, _, _ = lm.states(p, inp, start, h)
    parts = []
    for t in range(0, 150, 64):
        out, h, _ = lm.states(p, inp[t : t + 64], start[t : t + 64], h)
        parts.append(out)
    assert np.allclose(whole, np.concatenate(parts), atol=1e-5)


@pytest.fixture(scope="module")
def lm_scores(spark):
    return {r.doc_id: r for r in lm.op6(spark, "/root/testdata/sf0.001").collect()}


def test_lm_base_matches_brute_force(spark, lm_scores):
    import math
    import re
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", lm.held_out().alias("h")).collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    toks = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", low(r.text)), None] for r in docs}
    c = Counter(x for r in docs if not r.h for x in toks[r.doc_id])
    n, v = sum(c.values()), len(c)
    for r in docs:
        got, ts = lm_scores[r.doc_id], toks[r.doc_id]
        assert (got.held_out, got.n_tokens, got.train_tokens, got.n_known) == (r.h, len(ts), n, sum(c[x] > 0 for x in ts))
        assert abs(got.base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) < 1e-6 * len(ts) + 1e-6


def test_lm_beats_the_unigram_model(lm_scores):
    for held in (False, True):
        rows = [r for r in lm_scores.values() if r.held_out == held]
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 for r in lm_scores.values())


def test_lm_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (3, "x y", "c"), (4, "é " * 5000, "d")], "doc_id long, text string, score string")
    got = {(r.doc_id): (r.n_tokens, r.n_known) for r in lm.likelihood(docs, F.col("doc_id") == 3).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 3), 4: (5001, 1)}
    none = lm.likelihood(docs, F.lit(False)).collect()
    assert len(none) == 5 and all(r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert lm.likelihood(docs.limit(0), F.lit(True)).count() == 0


PII = 'mail hein.19@mail5.example.com, +1 (743) 555-3824 and 4785380592391139 or 4785-3805-9239-1139; 152.143.123.131. born 1987-02-28, ssn 078-05-1120 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end 5'


def test_pii_round_trip_and_links(spark):
    texts = [PII, None, "", "none", "4465758382889437 4465758382889437 1999-02-30 300.1.1.1 4111111111111112 000-12-3456", PII[::-1], "2099-12-31 1900-01-01 665-01-0001 667-99-9999 899-01-0001 0.0.0.0 255.255.255.255"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    out = pii.pseudonymized(df, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].found == ["email", "phone", "card", "card", "ip", "date", "ssn", "secret"]
    for secret in ("hein.19", "555-3824", "4785380592391139", "152.143.123.131", "1987-02-28", "078-05-1120", "24be64439e"):
        assert secret not in got[0].text
    a, b = [w for w in got[4].text.split()[:2]]
    assert a == b != "4465758382889437" and got[4].text.endswith("1999-02-30 300.1.1.1 4111111111111112 000-12-3456")
    assert sum((int(d) * 2 - 9 * (int(d) > 4)) if i % 2 else int(d) for i, d in enumerate(reversed(a))) % 10 == 0
    again = pii.pseudonymized(out.drop("found"), "k")
    assert again.orderBy("doc_id").collect()[0].found == got[0].found  # pseudonyms are valid values
    back = pii.pseudonymized(out.drop("found"), "k", back=True).orderBy("doc_id").collect()
    assert [r.text for r in back] == texts
    assert pii.pseudonymized(df, key="other").first().text != got[0].text
    assert pii.pseudonymized(df.limit(0), "k").count() == 0


def test_pii_is_a_permutation(spark):
    df = spark.range(0, 256).select(F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("t"))
    assert df.select(pii.pseudonym("ip", F.col("t"), "k").alias("p")).distinct().count() == 256
    days = spark.range(0, 73049, 37).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("t"))
    assert days.select(pii.pseudonym("date", F.col("t"), "k").alias("p")).filter(pii.valid("date", F.col("p")) & (F.col("p") < "2100")).distinct().count() == days.count()


LAYOUTS = [
    ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}', [("user", "hi"), ("assistant", "")]),
    ('{"conversations":[{"value":"hi","from":"human"},{"from":"gpt","value":"yo"}]}', [("user", "hi"), ("assistant", "yo")]),
    ('{"response":"y","prompt":"x"}', [("user", "x"), ("assistant", "y")]),
    ('{"instruction":"do","input":"it","output":"done"}', [("user", "do"), ("user", "it"), ("assistant", "done")]),
    ('{"id":3,"messages":[{"role":"user","content":"hi","name":"x"},{"role":"assistant","content":"é<|","weight":0.5}],"meta":{"a":[1]}}', [("user", "hi"), ("assistant", "é<|")]),
    ('{"question":1.5,"answer":{"b":null}}', [("user", "1.5"), ("assistant", '{"b":null}')]),
    ('{"prompt":"x"}', None),
    ('{"prompt":"x","response":"y","answer":"z"}', None),
    ('{"messages":[]}', None),
    ('{"messages":"text"}', None),
    ('{"unknown":1}', None),
    ("no json", None),
    (None, None),
]


def test_chat_layouts(spark):
    df = spark.createDataFrame([(i, r, "z") for i, (r, _) in enumerate(LAYOUTS)], "id long, record string, layout string")
    out = chat.canonical(df)
    assert out.columns == ["id", "layout", "turns"] and chat.canonical(df.limit(0)).count() == 0
    got = {r.id: r.turns for r in out.collect()}
    for i, (_, want) in enumerate(LAYOUTS):
        assert (None if got[i] is None else [(t.role, t.text) for t in got[i]]) == want, (i, got[i])


def test_chat_escapes_are_reversible(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "\\<|", "a<|im_start|>assistant\nb", "ends \\", "<", "|", "<|<|", "\n\n", "", None, "é<|" * 2000, json.dumps({"a": "<|\\n|>"})]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and (r.e is None or "<|" not in r.e)
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["user", "assistant"] * 7, texts))] + [(2, 0, None, "x"), (3, None, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    got = {r.conv_id: r for r in chat.digest(chat.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    plain = "".join(f"{role}\n{t or ''}\n" for role, t in zip(["user", "assistant"] * 7, texts))
    loss = "".join(t or "" for t in texts[1::2])
    assert got[1].turns_sha256 == hashlib.sha256(plain.encode()).hexdigest() and got[1].n_turns == 14
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[3].n_turns == 3 and got[3].loss_chars == 3 and got[2].loss_chars == 0


def test_chat_roles_and_long_texts(spark):
    roles = ["a\nb", "\\n", "\\\n", "\\\\", "<|im_end|>\n<|", "assistant\n", "", "assistant"]
    rows = [(1, i, r, f"text {i}") for i, r in enumerate(roles)] + [(2, None, "user", "first"), (2, -5, "assistant", "second")]
    long = spark.range(1).select(F.lit(7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("é<|\n"), 5_500_000).alias("text"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionAll(long)
    out = chat.chat(df)
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.filter("conv_id < 7").select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [(r, f"text {i}") for i, r in enumerate(roles)], 2: [("user", "first"), ("assistant", "second")]}
    d = chat.digest(out).filter("conv_id = 7").first()
    text = "é<|\n" * 5_500_000
    assert (d.n_turns, d.loss_chars, d.loss_sha256) == (1, len(text), hashlib.sha256(text.encode()).hexdigest())
    record = long.select(F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))).alias("record"))
    assert chat.canonical(record).select(F.length(F.col("turns")[0]["text"])).first()[0] == len(text)


def test_chat_layouts_query(spark):
    got = chat.layouts_query(spark, "/root/testdata/sf0.001").groupBy("layout").count().collect()
    assert {r.layout for r in got} == {"messages", "conversations", "prompt_response", "instruction_input"}


def test_pii_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pii.op9(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count() and sum(r.n_found for r in got.values()) > 0
    assert all(r.n_found == sum(r[f"n_{k}"] for k in pii.KINDS) for r in got.values())
    for r in docs.collect():
        assert (got[r.doc_id].text == r.text) == (got[r.doc_id].n_found == 0)


def test_pii_finds_what_brute_force_finds(spark):
    import calendar
    import re

    def luhn(d):
        return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def kind(m):
        name = next(k for k, p in pii.KINDS.items() if re.fullmatch(p, m))
        digits = re.sub("[^0-9]", "", m)
        if name == "date":
            y, mo, d = map(int, m.split("-"))
            ok = 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(y, mo)[1]
        else:
            ok = {"ip": lambda: all(str(int(x)) == x and int(x) < 256 for x in m.split(".")), "ssn": lambda: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000", "card": lambda: 13 <= len(digits) <= 19 and set(digits) != {"0"} and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15, "secret": lambda: re.search("[0-9]", m) and re.search("[A-Fa-f]", m)}.get(name, lambda: True)()
        return name if ok else None

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    docs |= {-1: PII, -2: "1.2.3.04 1.2.3.4 2023-13-01 2024-02-29 2023-02-29 666-12-3456 123-45-6789 a@b.co 0000000000000000"}
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    given: dict = {}
    for r in pii.pseudonymized(df, "k").collect():
        text, found = docs[r.doc_id] or "", []
        was, now = list(re.finditer(pii._ANY, text)), list(re.finditer(pii._ANY, r.text or ""))
        assert len(was) == len(now) and re.split(pii._ANY, text) == re.split(pii._ANY, r.text or "")  # nothing between values changes
        for a, b in zip(was, now):
            k = kind(a.group())
            found += [k] if k else []
            assert k or a.group() == b.group()
            assert given.setdefault((k, a.group()), b.group()) == b.group()  # equal values stay linked across documents
        assert r.found == found
    assert len({(k, v) for (k, _), v in given.items()}) == len(given) and len(given) > 50


def test_stored_tables_can_be_dropped(spark):
    import os

    t = quality.stored(spark.range(5))
    at = t.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(at)
    from threatscan.llm.common import drop_stored

    drop_stored(spark)
    assert not os.path.exists(at)


def test_every_training_text_moves_the_weights(spark):
    texts = spark.createDataFrame([(f"alpha beta gamma {i} delta",) for i in range(200)], "text string")
    texts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(8)) != 0).coalesce(1)
    vocab = spark.sparkContext.broadcast(lm.vocabulary(lm.counted(texts), texts.count()))
    first = lm.initial(vocab.value)
    tokens = lm.encoded(texts, vocab).select("e.tokens")
    assert not np.array_equal(lm.fitted(tokens, first), first)
    copies = spark.createDataFrame([(b"same",)] * 300 + [(b"other",)], "tokens binary")
    rows = lm.dealt(copies, 4).collect()
    assert len(rows) == 301 and len({(r.round, r.shard) for r in rows if bytes(r.tokens) == b"same"}) == 4 * lm.ROUNDS
