"""Rules, results and suffixes as tables; the mail model against its formula."""

import math
import re

import pytest
from pyspark.sql import functions as F

from threatscan.operators import documents as D
from threatscan.operators import findings as N
from threatscan.operators import mail as M
from threatscan.operators import urls as U
from threatscan.rules import documents as R
from threatscan.sources import files as S


def test_chain_table_equals_the_chains(spark):
    import random

    rng = random.Random(1)
    names = sorted({f for rules in R.CHAINS.values() for test, _ in rules for f in re.split(r" & |\|", test)}) + ["other"]
    rows = [(f"{p}{i}", p, k, rng.choice(names)) for p in R.CHAINS for i in range(25) for k in range(rng.randint(0, 6))] + [("n", None, 0, "dde_attack"), ("m", "docx", 0, None)]
    df = spark.createDataFrame(rows, "id string, profile string, ord int, finding string")
    for phase in ("full", "compat"):
        got = sorted(map(tuple, N.implied_findings(df, N.chain_table(spark, phase)).select("id", "ord", "finding").collect()))
        want = sorted((r.id, r.ord, r.finding) for p in R.CHAINS for r in N.chains(df.filter(F.col("profile") == p), p, phase=phase).collect())
        assert got == want and want


def test_a_users_own_chain(spark):
    own = spark.createDataFrame([("pdf", 0, 0, "a", "both"), ("pdf", 0, 1, "b", "both"), ("pdf", 0, 1, "c", "both"), ("pdf", 1, 0, "z", "never")], N.CLAUSES)
    df = spark.createDataFrame([(1, "pdf", "a"), (1, "pdf", "a"), (1, "pdf", "c"), (2, "pdf", "a"), (3, "pdf", "b"), (3, "pdf", "c"), (4, "docx", "a"), (4, "docx", "b")], "id long, profile string, finding string")
    assert [tuple(r) for r in N.implied_findings(df, own).collect()] == [(1, "pdf", 100_000, "both")]
    assert N.implied_findings(df.limit(0), own).count() == 0 == N.implied_findings(df, own.limit(0)).count()


def test_replayed_batches_leave_the_same_table(spark, tmp_path):
    at = str(tmp_path / "results")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, score int, verdict string")
    put = S.sink(at, "url", "a")
    put(rows((1, 90, "PHISHING"), (2, 10, "SAFE")), 0)
    put(rows((3, 50, "SUSPICIOUS")), 1)
    S.sink(at, "email", "b")(rows((1, 5, "Safe")), 0)
    read = lambda: sorted(map(tuple, S.read_history(spark, at).collect()))
    once = read()
    assert once == [("email", "b", 0, "1", 5, "Safe"), ("url", "a", 0, "1", 90, "Phishing"), ("url", "a", 0, "2", 10, "Safe"), ("url", "a", 1, "3", 50, "Suspicious")]
    put(rows((1, 90, "PHISHING"), (2, 10, "SAFE")), 0)
    assert read() == once


def test_a_stream_writes_through_the_sink(spark, tmp_path):
    at, source = str(tmp_path / "out"), str(tmp_path / "in")
    spark.createDataFrame([(i, i, "SAFE") for i in range(5)], "id long, score int, verdict string").write.parquet(source)
    for _ in range(2):  # the second query begins anew, and its batch 0 again
        stream = spark.readStream.schema("id long, score int, verdict string").parquet(source)
        stream.writeStream.foreachBatch(S.sink(at, "url", "q")).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in S.read_history(spark, at).collect()) == list("01234")


SUFFIXES = ["com", "uk", "co.uk", "ac.in", "in", "*.ck", "!www.ck", "kobe.jp", "jp"]
CASES = {
    "https://mail.google.com/x": "google.com", "http://a.b.shop.co.uk": "shop.co.uk", "http://co.uk/": "co.uk", "http://paruluniversity.ac.in": "paruluniversity.ac.in", "http://www.paruluniversity.ac.in:80/": "paruluniversity.ac.in",
    "http://a.shop.x.ck": "shop.x.ck", "http://x.ck": "x.ck", "http://a.www.ck": "www.ck", "http://www.ck": "www.ck", "http://A.B.Unknown": "b.unknown", "http://localhost": "localhost", "http://com": "com", "http://uk": "uk", None: None,
}


def test_registered_domains(spark):
    df = spark.createDataFrame([(u, 1) for u in CASES] * 2, "url string, registered_domain int").drop("registered_domain")
    table = spark.createDataFrame([(x,) for x in [*SUFFIXES, "com", None]], "suffix string")
    got = U.registered_domain(df, table).collect()
    assert len(got) == 2 * len(CASES) and {r.url: r.registered_domain for r in got} == CASES
    known = {r.url: r.trusted for r in U.trusted(df, table).collect()}
    assert known["http://www.paruluniversity.ac.in:80/"] and known["https://mail.google.com/x"] and not known["http://a.b.shop.co.uk"]
    plain = {r.url: r.trusted for r in U.trusted(df.filter("url is not null")).collect()}
    assert plain["https://mail.google.com/x"] and not plain["http://www.paruluniversity.ac.in:80/"]  # two labels are never enough there


def test_errors_stand_beside_findings(spark):
    import io
    import zipfile

    from threatscan.operators.scan import scan_documents

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:t>verify your account</w:t>")
        z.writestr("word/embeddings/a.exe", "MZ")
        z.writestr("word/broken.xml", "x" * 50)
    content = bytearray(b.getvalue())
    at = content.index(b"x" * 50)
    content[at : at + 3] = b"yyy"  # its checksum fails now
    files = spark.createDataFrame([("a.docx", "/in/a.docx", len(content), bytes(content)), ("b.docx", "/in/b.docx", 3, b"bad"), ("c.pdf", "/in/c.pdf", 4, b"%PDF")], "id string, path string, length long, content binary")
    got = {r.id: r for r in scan_documents(files, clauses=N.chain_table(spark)).collect()}
    assert [e.part for e in got["a.docx"].errors] == ["word/broken.xml"] and "CRC" in got["a.docx"].errors[0].error
    assert {"embedded_executable", "phishing_keyword", "dropper_pattern", "malformed_zip"} <= {b.finding_type for b in got["a.docx"].breakdown}
    assert got["b.docx"].errors[0].error.startswith("bad container") and got["c.pdf"].errors is None
    assert got["a.docx"].score == scan_documents(files).filter("id = 'a.docx'").first().score


def test_mail_probabilities_follow_the_formula(spark):
    """Multinomial naive Bayes over TF-IDF, computed word by word."""
    texts = [("win money now", 1.0), ("win a prize prize", 1.0), ("meeting at noon", 0.0), ("lunch meeting money", 0.0), ("see you at the meeting", 0.0)]
    new = ["win money", "meeting at the prize", "unknown words", "", "Money! money"]
    features = 1 << 16
    model = M.phishing_model(spark.createDataFrame(texts, "text string, label double"), features)
    got = {r.text: r.p for r in M.probability(model, spark.createDataFrame([(t,) for t in new], "text string")).collect()}
    words = lambda t: [w for w in re.split(r"\W+", t.lower()) if w]
    m = len(texts)
    idf = lambda w: math.log((m + 1) / (sum(w in words(t) for t, _ in texts) + 1))
    score: dict = {}
    for label in (0.0, 1.0):
        own = [words(t) for t, y in texts if y == label]
        weight = lambda w: sum(d.count(w) for d in own) * idf(w)  # noqa: B023, E731
        total = sum(weight(w) for w in {w for d in own for w in d})
        prior = math.log(len(own) + 1) - math.log(m + 2)
        for t in new:
            score[t, label] = prior + sum(idf(w) * (math.log(weight(w) + 1) - math.log(total + features)) for w in words(t))
    for t in new:
        assert got[t] == pytest.approx(1 / (1 + math.exp(score[t, 0.0] - score[t, 1.0])), abs=1e-9)


def test_part_errors_are_in_order(spark):
    parts = spark.createDataFrame([("a", 2, "z", "late"), ("a", 1, "y", "early"), ("a", 0, "x", None), ("b", 0, "x", None)], "id string, entry_ord int, entry_name string, error string")
    assert [(r.id, [tuple(e) for e in r.errors]) for r in S.part_errors(parts).collect()] == [("a", [("y", "early"), ("z", "late")])]
    assert D.part_findings(parts.withColumn("data", F.lit(b"MZ")), "docx").filter("id = 'b'").count() == 1


def test_own_analyzers_take_part_in_a_scan(spark, monkeypatch):
    from threatscan.operators.scan import document_findings

    monkeypatch.setattr(N, "ANALYZERS", {})

    @N.analyzer("pdf:notes")
    def notes(df):
        return N.as_rows(df, [(F.col("note").contains("bad"), "bad_note")])

    files = spark.createDataFrame([("a", "/in/a.pdf", 4, b"%PDF"), ("b", "/in/b.docx", 3, b"bad")], "id string, path string, length long, content binary")
    table = spark.createDataFrame([("a", "bad"), ("a", "good"), ("b", "bad")], "id string, note string")
    got = document_findings(files, {"pdf:notes": table}).filter("finding = 'bad_note'").collect()
    assert [(r.id, r.profile) for r in got] == [("a", "pdf")]


def test_mail_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: x@y.example\nSubject: hi\n\nBody\n")
    (tmp_path / "b.txt").write_bytes(b"no mail")
    got = S.read_mails(spark, str(tmp_path)).collect()
    assert [(r.sender, r.text_body.strip(), r.reject_reason) for r in got] == [("x@y.example", "Body", None)] and got[0].path.endswith("a.eml")
