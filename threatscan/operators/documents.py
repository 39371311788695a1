"""Findings of PDF bytes, office containers, macros and images, as native tests over tables.

Each producer takes a table and gives ``(id, ord, finding)`` rows. Bytes are
read as Latin-1 text once; parts of containers are rows of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threatscan.functions import text as X
from threatscan.functions.tables import components, stored
from threatscan.operators.findings import as_rows
from threatscan.operators.url_findings import is_safe, part, url_findings
from threatscan.rules import documents as R


def raw_text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def utf8(name: str) -> Column:
    """Bytes as UTF-8 text; what is none is replaced."""
    return F.make_valid_utf8(F.col(name).cast("string"))


def _has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def _any(text: Column, parts) -> Column:
    return X.contains_any(text, parts)


def base64_like(text: Column, least: int) -> Column:
    """A run of base64 characters of at least so many."""
    return text.rlike(rf"[A-Za-z0-9+/]{{{least},}}")


def chunk_entropies(text: Column, size: int = 100, upto: int = 5000) -> Column:
    """Entropy of each piece of the start of a text; 0 for pieces under 20 characters."""
    n = F.least(F.length(text), F.lit(upto))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.transform(F.array(F.substr(text, s, F.least(F.lit(size), n - s + 1))), lambda c: F.when(F.length(c) < 20, 0.0).otherwise(F.round(X.entropy(c), 2)))[0])


def high_chunks(text: Column, above: float, size: int = 100, upto: int = 5000) -> Column:
    """How many of ``chunk_entropies`` are over ``above``. So many bits take more different characters than most texts have at all, so entropies are computed for few."""
    least = 2**above
    start = F.substr(text, F.lit(1), F.lit(upto))
    varied = F.size(F.array_distinct(F.split(start, ""))) > least
    return F.when(varied, F.size(F.filter(chunk_entropies(start, size, upto), lambda e: e > above))).otherwise(0)


def _utf16_text(h: Column) -> Column:
    """Hex digits as UTF-16 text by their byte order mark, or big-endian where many bytes are zero; null for others. Unpaired surrogates go."""
    start = F.upper(F.substr(h, F.lit(1), F.lit(2000)))
    n = F.length(start)
    zeros = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2)), lambda i: F.substr(start, i, F.lit(2)) == "00")) * 2 / F.greatest(n, F.lit(1))
    even = F.substr(start, F.lit(1), n - n % 4)
    big, small = F.regexp_replace(even, "(..)(..)", r"\\u$1$2"), F.regexp_replace(even, "(..)(..)", r"\\u$2$1")
    units = F.when(start.startswith("FEFF"), big).when(start.startswith("FFFE"), small).when(zeros >= 0.2, big)
    paired = F.regexp_replace(units, r"\\uD[89AB]..(?!\\uD[C-F]..)|(?<!\\uD[89AB]..)\\uD[C-F]..", "")
    return F.when(n % 2 == 0, F.from_json(F.concat(F.lit('{"t":"'), paired, F.lit('"}')), "t string")["t"])


def is_utf16_prose(h: Column) -> Column:
    """Whether hex digits are mostly printable UTF-16 text of letters and spaces, as titles in many harmless files are."""

    def of(text):
        t = F.regexp_replace(F.regexp_replace(text, "^[\\x00\ufeff]+|[\\x00\ufeff]+$", ""), r"(?U)^\s+|\s+$", "")
        share = lambda p: F.regexp_count(t, F.lit(p)) / F.greatest(F.length(t), F.lit(1))
        return (F.length(t) >= 6) & (share(r"[^\p{C}\p{Z}]| ") >= 0.9) & (share(r"(?U)\p{L}|\s") >= 0.6)

    return F.coalesce(F.transform(F.array(_utf16_text(h)), of)[0], F.lit(False))


def suspicious_hex(h: Column) -> Column:
    """A hex run that decodes to script-like ASCII text and not to UTF-16 prose; one of an odd number of digits decodes to nothing."""
    start = F.substr(h, F.lit(1), F.lit(4000))
    b = F.decode(F.unhex(F.when(F.length(start) % 2 == 0, start)), "ISO-8859-1")
    ascii_share = F.regexp_count(b, F.lit(r"[\x20-\x7E\t\n\r]")) / F.greatest(F.length(b), F.lit(1))
    return F.coalesce((F.length(h) >= 120) & (ascii_share >= 0.7) & _any(F.lower(b), R.HEX_TOKENS) & ~is_utf16_prose(h), F.lit(False))


def pdf_findings(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Findings of raw PDF texts ``(id, raw)``."""
    files = files.select("id", F.col(raw).alias("raw"), F.lower(raw).alias("low"))
    t, low = F.col("raw"), F.col("low")
    active = _any(t, R.ACTIVE)
    objects = F.regexp_count(t, F.lit(r"\d+ \d+ obj"))
    opened = F.lit(False)
    for token in R.OPEN_DANGER:  # the token must lie within 800 characters from the start of the action
        opened = opened | t.rlike(rf"(?s)/OpenAction.{{0,{789 - len(token)}}}\Q{token}\E")
    scripted = _any(low, ["/javascript", "/js", "/aa", "/launch"])
    hexes = F.regexp_extract_all(t, F.lit("[0-9a-fA-F]{40,}"), F.lit(0))
    rules = [
        (_has(t, "/JavaScript"), "javascript_detected"), (_has(t, "/JS"), "javascript_detected"), (opened, "openaction_detected"), (_has(t, "/Launch"), "launch_action_detected"),
        (_has(t, "/EmbeddedFile"), "embedded_file_detected"), (_has(t, "/AcroForm"), "acroform_detected"), (_has(t, "/XFA"), "xfa_form_detected"), (_has(t, "/ObjStm") & active, "high_object_count"),
        ((objects > 1200) | ((objects > 600) & active), "high_object_count"), (_has(t, "/Encrypt"), "encrypted_object"), (_has(t, "MZ\x90\x00") | _has(t, "MZ\x00\x00"), "embedded_executable"),
        (X.n_contained(low, R.SHELL_WORDS), "powershell_detected"), (X.n_contained(low, R.DROPPER_WORDS), "dropper_pattern"), (base64_like(t, 101), "base64_payload"),
        (F.exists(hexes, suspicious_hex), "hex_payload"), (high_chunks(t, 6.5) >= 3, "high_entropy_string"),
        (sum((low.rlike(p).cast("int") for p in R.NETWORK_PATTERNS), F.lit(0)), "external_network_call"),
        (F.when(scripted, sum((low.rlike(p).cast("int") for p in R.SPLIT_PATTERNS), F.lit(0))).otherwise(0), "split_string_concat"),
    ]
    return as_rows(files, rules)


def pdf_page_findings(pages: DataFrame, links: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Findings of page tables ``(id, page, text, n_images)`` and links ``(id, page, visible_text, url)``.

    A file of images with hardly any text is suspicious only beside a link, a
    phrase or a finding about an address. Phrases and addresses are sought in
    the pages and links here; ``earlier`` brings further findings ``(id,
    finding)`` of the same files, of its anchors for one.
    """
    text = F.coalesce("text", F.lit(""))
    size = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    read = pages.select("id", "page", "n_images", text.alias("text"), F.length(text).alias("n"), size(r"(?U)^\s+").alias("from_left"), size(r"(?U)\s+$").alias("from_right"))
    images = read.groupBy("id").agg(F.sum("n_images").alias("images"))
    # the length of all pages' text without white space around it
    rims = read.filter("from_left > 0").groupBy("id").agg(F.min(F.struct("page", F.expr("n - from_left").alias("less"))).alias("a"), F.max(F.struct("page", F.expr("n - from_right").alias("less"))).alias("z"))
    chars = read.join(rims, "id").filter("page between a.page and z.page").groupBy("id").agg((F.sum("n") - F.max("a.less") - F.max("z.less")).alias("chars"))
    web = links.filter(F.coalesce("url", F.lit("")) != "")
    phrased = read.filter(_any(F.lower("text"), [t for _, t in R.phrases("pdf")])).select("id")
    urls = web.select("id", "url").unionByName(read.select("id", F.explode(F.regexp_extract_all("text", F.lit(R.PAGE_URL), F.lit(0))).alias("url")))
    told = urls.select("id", F.explode(url_findings(F.col("url"), "pdf")).alias("finding"))
    if earlier is not None:
        told = told.unionByName(earlier.select("id", "finding"))
    signs = phrased.unionByName(told.filter(F.col("finding").isin(R.ADDRESS_FINDINGS)).select("id")).distinct().withColumn("signs", F.lit(True))
    met = images.join(chars, "id", "left").join(web.groupBy("id").agg(F.count(F.lit(1)).alias("links")), "id", "left").join(signs, "id", "left").fillna({"chars": 0, "links": 0, "signs": False})
    shown = (F.col("images") >= 1) & (F.col("chars") < 100)
    rules = [(shown & ((F.col("links") > 0) | F.col("signs")), "single_image_pdf"), ((F.col("images") > 0) & (F.col("links") > 0) & (F.col("links") >= F.col("images")), "clickable_image_overlay")]
    return as_rows(met, rules, start=100)


def macro_findings(code: DataFrame, profile: str) -> DataFrame:
    """Findings of macro source ``(id, code)``, one row for each file.

    A column ``suspicious`` (int), if there is one, counts the streams that an
    upstream macro analysis calls suspicious: each is a ``hidden_macro_stream``
    of a text document.
    """
    hidden = [(F.col("suspicious"), "hidden_macro_stream")] if profile == "docx" and "suspicious" in code.columns else []
    code = code.withColumn("__low", F.lower("code"))
    low = F.col("__low")
    first = "vba_macro_detected" if profile == "pptx" else "malicious_macro"
    rules: list = [(F.lit(True), first), *hidden, (X.n_contained(low, R.AUTO_OPEN[profile]), "ppt_autoopen" if profile == "pptx" else "autoopen_macro")]
    for category, finding in R.MACRO_FINDINGS.items():
        words = [w for c, w in R.MACRO_WORDS[profile] if c == category]
        if words:
            rules.append((X.n_contained(low, words), finding))
    if profile == "pptx":
        rules += [(_any(low, words), finding) for finding, words in R.PPT_MACRO_ONCE.items()]
        rules.append((_has(low, "shell") & (_has(low, "cmd") | _has(low, "exe")), "shell_command"))
        lines = F.exists(F.split("code", "\n"), lambda x: F.when(F.length(x) > 50, X.entropy_over(x, 5.5)).otherwise(F.lit(False)))
        rules += [
            (base64_like(F.col("code"), 40), "base64_payload"), (F.regexp_count(low, F.lit(r"chr\(\d+\)")) > 5, "char_concat_obfuscation"),
            (low.rlike("|".join(R.STRING_SPLITS)), "string_split_obfuscation"), (lines, "high_entropy_string"),
        ]
    else:
        start = F.substr(low, F.lit(1), F.lit(1000))
        signatures = R.SIGNATURES_DOCX if profile == "docx" else R.SIGNATURES
        rules += [
            (base64_like(low, 50), "encoded_macro_payload"), (low.rlike("[0-9a-f]{40,}"), "encoded_macro_payload"), (sum((low.rlike(p).cast("int") for p in R.CONCAT_PATTERNS), F.lit(0)), "string_obfuscation"),
            ((F.length(start) >= 20) & X.entropy_over(start, 5.5, 2), "high_entropy_string"), (X.n_contained(low, signatures), "known_macro_signature"),
        ]
    return as_rows(code, rules, start=200)


def file_findings(files: DataFrame, profile: str) -> DataFrame:
    """Findings of names ``(id, path)``: extension, double extension, special formats."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ext = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    inner = F.regexp_extract(name, r"\.([^.]+)\.[^.]+$", 1)
    special = {"xlsx": [(ext == ".xlsm", "xlsm_file"), (ext == ".xlsb", "xlsb_file"), (ext == ".xltm", "malicious_macro")], "docx": [(ext == ".docm", "malicious_macro")], "pptx": [(ext.isin(".pptm", ".ppsm"), "vba_macro_detected"), (ext.isin(".pps", ".ppsx"), "pps_file")], "image": []}
    bad = {"image": "invalid_image_format", "pptx": "invalid_ppt_format"}.get(profile, "file_type_mismatch")
    return as_rows(files, [(~ext.isin(R.VALID_EXTENSIONS[profile]), bad), (inner.isin(R.DANGEROUS_INNER[profile]), "double_extension"), *special[profile]], start=300)


def missing_parts(files: DataFrame, parts: DataFrame, profile: str) -> DataFrame:
    """Files ``(id)`` without their main part (slides, for a deck) or with an unreadable container."""
    none = lambda df, f: df.select("id", F.lit(310).alias("ord"), F.lit(f).alias("finding"))
    bad_zip = parts.filter("error is not null").select("id").distinct()
    if profile == "pptx":
        whole = parts.filter("entry_ord < 0 and error is not null").select("id").distinct()
        slides = parts.filter(F.col("entry_name").contains("ppt/slides/slide")).select("id")
        empty = files.select("id").join(slides.unionAll(whole), "id", "left_anti")
        return none(empty, "malformed_zip").unionByName(none(whole, "file_type_mismatch")).unionByName(none(bad_zip.join(whole, "id", "left_anti"), "malformed_zip"))
    main = parts.filter(F.col("entry_name") == R.MAIN_PART[profile])
    broken = files.select("id").join(main.select("id"), "id", "left_anti")
    return none(broken, "corrupted_structure").unionByName(none(bad_zip, "malformed_zip"))


def external_links(parts: DataFrame) -> DataFrame:
    """One finding for each workbook that has links to other workbooks."""
    return parts.filter(F.col("entry_name").contains("xl/externalLinks")).select("id").distinct().select("id", F.lit(690).alias("ord"), F.lit("external_data_connection").alias("finding"))


def metadata_findings(files: DataFrame, parts: DataFrame, profile: str) -> DataFrame:
    """Findings of ``docProps/core.xml``: author, times and revision."""
    core = parts.filter("entry_name = 'docProps/core.xml'").select("id", utf8("data").alias("x"))
    tag = lambda n: F.trim(F.regexp_extract("x", rf"<{n}[^>]*>([^<]*)</{n}>", 1))
    met = files.select("id").join(core, "id", "left").withColumns({"author": F.coalesce(tag("dc:creator"), F.lit("")), "made": F.try_to_timestamp(tag("dcterms:created")), "changed": F.try_to_timestamp(tag("dcterms:modified")), "revision": F.coalesce(tag("cp:revision"), F.lit(""))})
    if profile == "pptx":
        app = parts.filter("entry_name = 'docProps/app.xml'").select("id", F.lower(F.regexp_extract(utf8("data"), r"(?s)<Application>(.*?)</Application>", 1)).alias("app"))
        met = met.join(app, "id", "left")
    same = F.abs(F.unix_timestamp("made") - F.unix_timestamp("changed"))
    generic = F.lower("author").isin(R.GENERIC_AUTHORS[profile])
    if profile == "pptx":
        rules = [(F.col("author") == "", "wiped_metadata"), (generic, "suspicious_author"), (F.col("revision") == "1", "low_revision_count"), (same == 0, "metadata_mismatch"), (_any(F.col("app"), R.ODD_APPLICATIONS), "suspicious_metadata")]
    else:
        rules = [(F.col("author") == "", "wiped_metadata"), (generic, "suspicious_metadata"), (same < 2, "suspicious_metadata"), (F.col("revision") == "1", "suspicious_metadata")]
    return as_rows(met, rules, start=320)


def _targets(x: Column, pattern: str) -> Column:
    """The targets of relationships in a part that match ``pattern``."""
    return F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda m: F.trim(F.regexp_extract(m, 'Target="([^"]+)"', 1)))


def _web(x: Column, safe: list[str]) -> Column:
    """Web addresses in a part that hold none of the safe domains."""
    return F.filter(F.regexp_extract_all(x, F.lit(r'https?://[^\s"<>]+'), F.lit(0)), lambda u: ~_any(F.lower(u), safe))


def part_findings(parts: DataFrame, profile: str) -> DataFrame:
    """Findings of single parts ``(id, entry_name, data)`` of a container.

    What only some parts can have is looked for in those alone, by their names.
    """
    p = parts.filter("error is null").select("id", "entry_name", F.lower("entry_name").alias("name"), "data", utf8("data").alias("x"), raw_text(F.substring("data", 1, 2000)).alias("head")).withColumn("low", F.lower("x"))
    given, name, x, low, head = (F.col(c) for c in ("entry_name", "name", "x", "low", "head"))
    xml, rels, mz = name.endswith(".xml"), given.endswith(".rels"), head.startswith("MZ")
    within = lambda test, n: F.when(test, n).otherwise(0)
    if profile == "pptx":
        embedded, slide, media = _has(name, "embeddings"), given.rlike(r"^ppt/slides/slide\d+\.xml"), _has(given, "ppt/media/")
        timed = slide & _has(x, "<p:timing>")
        acts = _any(x, ["hlinkClick", "hlinkMouseOver"]) | _has(low, "ppaction://")
        unlike = F.when(name.rlike(r"\.jpe?g$"), ~head.startswith("\xff\xd8\xff")).when(name.endswith(".png"), ~head.startswith("\x89PNG")).otherwise(F.lit(False))
        external = F.filter(_targets(x, R.EXTERNAL_TARGET), lambda u: (F.length(u) > 0) & ~_any(part(F.lower(u), 2), R.SAFE_DOMAINS))
        template = F.lower(F.regexp_extract(x, 'Type="([^"]+)"', 1)).contains("template")
        tests: list = [
            (embedded & name.endswith(".bin"), "embedded_ole_object"), (embedded & name.rlike(R.ending(R.EMBEDDED_EXECUTABLES["pptx"])), "embedded_executable"), (embedded & mz, "mz_header_found"),
            (within(slide, _any(low, ["oleobj", "oleobject"]).cast("int")), "embedded_ole_object"), (slide & x.rlike("<p:oleObj|oleObject"), "package_object"),
            (within(rels, F.size(external)), "external_relationship"), (within(rels, F.when(template, F.size(external)).otherwise(0)), "template_injection"),
            (within(rels, F.size(F.filter(external, lambda u: F.size(url_findings(u, "pptx")) > 0))), "suspicious_external_url"), (within(rels, F.size(F.filter(external, lambda u: _any(F.lower(u), R.TRACKER_IMAGES)))), "image_tracker"),
            (timed & _has(x, "<p:cmd"), "cmd_trigger_found"), (timed & x.rlike('<p:cTn[^>]*delay="0"'), "zero_delay_trigger"), (timed & _has(low, "mouseover"), "mouseover_trigger"), (timed, "suspicious_animation"),
            (slide & ~_has(x, "<p:ph") & _has(x, "hlinkClick"), "action_button_found"), (slide & ~_has(x, "<p:ph") & _has(x, "hlinkMouseOver"), "mouseover_action"), (slide & _has(low, "ppaction://macro"), "macro_action_button"),
            (slide & _any(low, ["ppaction://hlinksldjump", "ppaction://program"]), "run_program_action"), (slide & _has(x, "<a:noFill/>") & acts, "invisible_button"),
            (media & unlike, "media_type_mismatch"), (media & mz, "embedded_executable"), (media & (F.length("data") > 10240 * 1024), "large_media_file"), (within(media, X.entropy_over(head, 7.9).cast("int")), "high_entropy_media"),
            (_has(name, "vbaproject.bin"), "vba_macro_detected"),
        ]
        return as_rows(p, tests, start=400)
    embedded = _any(name, R.EMBEDDED_NAMES[profile])
    inner = F.substring_index(name, "/", -1)
    template = x.rlike('Target="https?://[^"]+"')
    images = F.regexp_count(x, F.lit('Target="https?://[^"]+"'))
    outside = F.filter(_targets(x, R.MODE_THEN_TARGET), lambda u: u.startswith("http"))
    settings = (given == "word/settings.xml") if profile == "docx" else _has(name, "settings") & given.endswith(".xml")
    other = ~xml & ~name.endswith(".rels")
    tests = [
        (embedded, "embedded_ole_object"), (embedded & name.rlike(R.ending(R.EMBEDDED_EXECUTABLES[profile])), "embedded_executable"), (embedded & inner.rlike(r"^\.|\..*\."), "double_extension_payload"),
        (name.rlike(R.ending(R.SCRIPTS)), "embedded_script"), (mz, "embedded_executable"), (rels & _has(x, "attachedTemplate") & template, "external_template"), (within(rels & _has(name, "image"), images), "external_image_tracker"),
        (within(rels, F.size(outside)), "suspicious_relationship"), (within(settings, F.size(_web(x, R.SAFE_HOSTS[profile]))), "hidden_relationship"), (within(other, X.entropy_over(F.substr("head", F.lit(1), F.lit(500)), 7.0).cast("int")), "high_entropy_string"),
    ]
    if profile == "docx":
        runs = F.regexp_extract_all(x, F.lit("[A-Za-z0-9+/]{100,}={0,2}"), F.lit(0))
        tests += [(xml & x.rlike("[0-9a-fA-F]{80,}"), "encoded_macro_payload"), (within(xml, F.exists(runs, lambda m: X.entropy_over(m, 5.5)).cast("int")), "encoded_macro_payload")]
    if profile == "xlsx":
        words = X.contained(low, R.XLM)
        of = lambda k: F.size(F.filter(words, lambda w: F.contains(w, F.lit(k))))
        hidden = lambda s: F.regexp_count(x, F.lit(rf'<sheet\b[^>]*state="{s}"'))
        book, link = name == "xl/workbook.xml", name == "xl/connections.xml"
        web = F.filter(F.regexp_extract_all(x, F.lit(r'https?://[^\s"<>\]]+'), F.lit(0)), lambda u: ~is_safe(u))
        tests += [
            (given.endswith(".xml") & _any(low, R.DDE), "dde_attack"), (within(xml, _has(low, "macrosheets").cast("int") + F.size(words) - of("exec") - of("run") - of("call")), "xlm_macro_detected"),
            (within(xml, of("exec")), "xlm_exec_command"), (within(xml, of("run")), "xlm_run_command"), (within(xml, of("call")), "xlm_call_command"),
            (within(book, hidden("hidden")), "hidden_sheet"), (within(book, hidden("veryHidden") + (hidden("veryHidden") > 0).cast("int")), "very_hidden_sheet"),
            (within(_has(name, "quer"), F.size(web)), "power_query_connection"), (link & _has(low, "oledb"), "ole_db_connection"),
            (within(link, F.size(X.contained(low, R.CONNECTIONS))), "suspicious_connection"), (within(link, F.size(web)), "external_data_connection"),
        ]
    return as_rows(p, tests, start=400)


def hidden_slides(parts: DataFrame) -> DataFrame:
    """Decks ``(id, entry_ord, entry_name, data)`` with hidden slides: one finding for the deck, and one for each of its last so many slides, in the container's order, that holds text."""
    whole = parts.filter("error is null")
    hidden = F.regexp_count(utf8("data"), F.lit('<p:sldId[^>]*show="0"[^>]*/>')).alias("n")
    decks = whole.filter("entry_name = 'ppt/presentation.xml'").groupBy("id").agg(F.max(hidden).alias("n")).filter("n > 0")
    texts = F.array_join(F.regexp_extract_all(utf8("data"), F.lit("<a:t>([^<]+)</a:t>"), F.lit(1)), " ")
    slides = whole.filter(F.col("entry_name").rlike(r"^ppt/slides/slide\d+\.xml")).select("id", "entry_ord", (F.trim(texts) != "").alias("told"))
    last = slides.withColumn("from_end", F.row_number().over(W.partitionBy("id").orderBy(F.desc("entry_ord")))).join(decks, "id").filter("from_end <= n and told")
    row = lambda df, f: df.select("id", F.lit(600).alias("ord"), F.lit(f).alias("finding"))
    return row(decks, "hidden_slide").unionByName(row(last, "hidden_slide_with_content"))


def cell_findings(cells: DataFrame) -> DataFrame:
    """Findings of workbook cells ``(id, value)``: formulas that call out, hide or spell text."""
    low = F.lower("value")
    formula = low.startswith("=")
    url = F.regexp_extract(low, r'https?://[^\s")\]]+', 0)
    rules = [
        (formula & _has(low, "=hyperlink(") & (url != "") & (F.size(url_findings(url, "xlsx")) > 0), "formula_hyperlink_injection"), (formula & _has(low, "=webservice("), "webservice_formula"), (formula & _has(low, "=indirect("), "formula_obfuscation"),
        (formula & (X.count_of(low, "char(") >= 4), "char_concat_formula"), (_any(low, R.DDE), "dde_attack"),
    ]
    return as_rows(cells, rules, start=700)


def image_findings(images: DataFrame) -> DataFrame:
    """Findings of image rows.

    ``images (id, path, head, size, width, height, ocr_text, ocr_conf, qr,
    white_share, sigma, clear_share)``: ``head`` are the first bytes as Latin-1
    text; the last three come from ``image_statistics``. A column ``ocr_error``,
    if there is one, says why no text could be read.
    """
    c = F.col
    failed = c("ocr_error").isNotNull() if "ocr_error" in images.columns else F.lit(False)
    images = images.withColumn("__text", F.coalesce("ocr_text", F.lit(""))).withColumn("__low", F.lower("__text"))
    t, low, name = c("__text"), c("__low"), F.lower("path")
    fits = F.when(name.endswith(".png"), c("head").startswith("\x89PNG")).when(name.rlike(r"\.jpe?g$"), c("head").startswith("\xff\xd8\xff")).when(name.endswith(".gif"), c("head").startswith("GIF")).when(name.endswith(".bmp"), c("head").startswith("BM")).otherwise(F.lit(True))
    words, pixels = X.word_count(t), c("width") * c("height")
    brands, h = X.contained(low, R.IMAGE_BRANDS), X.entropy(c("head"))
    qr = F.transform(F.coalesce("qr", F.array().cast("array<string>")), lambda u: F.trim(u))
    bad = lambda u: F.size(url_findings(u, "image")) > 0
    web = lambda u: u.startswith("http")
    odd = lambda u: F.when(web(u), ~bad(u)).otherwise(u.rlike(r"^\+?\d{10,15}$") | _any(F.lower(u), R.IMAGE_BRANDS))
    conf = F.filter(F.coalesce("ocr_conf", F.array().cast("array<int>")), lambda x: x >= 0)
    sure, mean = F.size(F.filter(conf, lambda x: x > 60)), F.try_divide(F.aggregate(conf, F.lit(0), lambda s, x: s + x), F.size(conf))
    graded = (F.size(conf) > 0) & (sure >= 15)
    own = r"[a-zA-Z0-9.-]+\.(?:com|org|net|in|co\.in|gov\.in|edu|io|xyz|top|ru|tk)"
    shown = F.transform(F.regexp_extract_all(t, F.lit(r"https?://([^\s/]+)"), F.lit(1)), F.lower)
    domains = F.concat(F.transform(F.regexp_extract_all(t, F.lit(own), F.lit(0)), F.lower), shown)
    n_domains = lambda test: F.size(F.filter(domains, test))
    secure = F.transform(F.regexp_extract_all(t, F.lit(r"https://([^\s/\]>]+)"), F.lit(1)), F.lower)
    imitates = F.filter(secure, lambda d: _any(d, R.IMAGE_BRANDS) & X.first_ending(d, R.TLDS["image"]).isNotNull())
    rules = [
        (~fits, "file_type_mismatch"), ((c("width") < 100) | (c("height") < 100), "suspicious_exif"), ((c("width") < 300) & (c("height") < 300), "blurred_image"), (F.trim(t) == "", "low_text_density"),
        ((pixels > 100_000) & (words < 10), "single_image_content"), (F.size(brands), "ocr_phishing_text"), ((F.size(brands) > 0) | (X.n_contained(low, R.LOGIN_WORDS) >= 2), "fake_login_page"), (F.size(qr) > 0, "qr_code_detected"),
        (F.size(F.filter(qr, lambda u: web(u) & bad(u))), "qr_malicious_url"), (F.size(F.filter(qr, odd)), "qr_suspicious_url"), (h > 7.95, "steganography_indicator"), ((h > 7.9) & (h <= 7.95), "high_entropy_image"),
        (F.try_divide(c("size"), pixels * 3) > 2, "suspicious_file_size"), (F.size(X.contained(low, R.HINDI)) > 0, "hindi_phishing_detected"), (t.rlike("[\\u0900-\\u097F]") & t.rlike("[A-Za-z]"), "mixed_script_detected"),
        (F.size(X.contained(t, list(R.HOMOGLYPHS))) + F.aggregate(domains, F.lit(0), lambda s, d: s + F.size(X.contained(d, R.SPOOFS))), "homograph_domain"), (n_domains(lambda d: d.rlike("[a-z]0[a-z]")) + n_domains(lambda d: d.rlike("[a-z]1[a-z]")), "char_substitution"),
        (n_domains(lambda d: F.contains(d, F.lit("rn"))) + n_domains(lambda d: F.contains(d, F.lit("vv"))), "lookalike_domain"), (c("white_share") > 0.95, "hidden_text_overlay"), (c("sigma") < 15, "low_contrast_text"), (c("clear_share") > 0.3, "transparent_layer"),
        (t.rlike("[\u2022*]{4,}"), "password_field_detected"), (_any(low, R.BUTTONS), "fake_submit_button"), (F.size(X.contained(low, R.FIELDS)) >= 2, "fake_login_form_detected"), (F.size(X.contained(low, R.BROWSER_SIGNS)), "fake_browser_ui"),
        (F.size(F.filter(secure, lambda d: bad(F.concat(F.lit("https://"), d)))) + F.size(imitates), "fake_address_bar"), (_any(low, R.PADLOCKS), "fake_padlock_detected"), (graded & (mean < 30), "blur_evasion_detected"), (graded & (mean >= 30) & (mean < 50), "low_ocr_confidence"), (failed, "ocr_failed"),
    ]
    return as_rows(images, rules, start=800)


def image_statistics(images: DataFrame) -> DataFrame:
    """``(id, white_share, mean, sigma, clear_share, height, width)`` of Spark's image rows ``(id, image)``; pixels are averaged in Arrow batches."""
    @F.pandas_udf("white_share double, mean double, sigma double, clear_share double")
    def stats(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, n in zip(data, channels, strict=True):
            px = np.frombuffer(raw, dtype=np.uint8).reshape(-1, max(int(n), 1)).astype(float)
            grey = px[:, : min(px.shape[1], 3)].mean(axis=1)
            rows.append((float((grey > 240).mean()), float(grey.mean()), float(grey.std()), float((px[:, 3] < 128).mean()) if px.shape[1] == 4 else 0.0) if len(px) else (0.0, 0.0, 0.0, 0.0))
        return pd.DataFrame(rows, columns=["white_share", "mean", "sigma", "clear_share"])

    return images.withColumn("s", stats("image.data", "image.nChannels")).select("id", "s.*", "image.height", "image.width")


def _blocks(blocks: int) -> list[int]:
    """Masks of the bit blocks of a 64-bit hash."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_keys(h: Column, blocks: int, agree: int) -> Column:
    """Each choice of ``agree`` of the ``blocks`` bit blocks of a 64-bit hash: the blocks as bits of ``choice``, all blocks up to its last one as bits of ``upto``, and the hash's bits in them."""
    masks, keys = _blocks(blocks), []
    for chosen in combinations(range(blocks), agree):
        of = sum(masks[i] for i in chosen)
        keys.append(F.struct(F.lit(sum(1 << i for i in chosen)).alias("choice"), F.lit((1 << (chosen[-1] + 1)) - 1).alias("upto"), h.bitwiseAND(F.lit(_signed(of))).alias("bits")))
    return F.array(*keys)


#: Different hashes of one key that a task compares at once; larger keys are dealt into parts.
PART = 4096


def _bit_masks(blocks: int) -> np.ndarray:
    return np.array(_blocks(blocks), dtype=np.uint64)


def _near(own: np.ndarray, h: np.ndarray, choice: int, upto: int, blocks: int, most: int):
    """Within the members of one key: ``(i, near, first)``, a member's place, those of all near ones after it, and of them those whose first common choice this is.

    ``own``, in order, numbers the part of each member; where there are two
    parts, pairs inside one are left to another task.
    """
    masks, weights = _bit_masks(blocks), np.left_shift(1, np.arange(blocks))
    cut = int(np.searchsorted(own, own[-1]))
    for i in range(cut or len(h) - 1):
        start = max(i + 1, cut)
        x = h[start:] ^ h[i]
        at = np.flatnonzero(np.bitwise_count(x) <= most)
        if len(at):
            equal = ((x[at, None] & masks[None, :]) == 0) @ weights
            yield i, at + start, at[(equal & upto) == choice] + start


def _walked(own: np.ndarray, h: np.ndarray, choice: int, upto: int, blocks: int, most: int) -> list[tuple]:
    """Within the members of one key: ``(hash, links, other)``, the links of each that are counted here, at the first common choice of a pair, and the edges of a spanning forest."""
    links, label, edges = np.zeros(len(h), np.int64), np.arange(len(h)), []
    for i, near, first in _near(own, h, choice, upto, blocks, most):
        links[i] += len(first)
        links[first] += 1
        others = label[near]
        for other in np.unique(others[others != label[i]]):
            edges.append((i, int(near[np.flatnonzero(others == other)[0]])))
            label[label == other] = label[i]
    signed = h.view(np.int64)
    return [(int(signed[k]), int(links[k]), None) for k in np.flatnonzero(links)] + [(int(signed[a]), 0, int(signed[b])) for a, b in edges]


_GROUP = ["choice", "bits", "p", "q"]


def _agreeing(n: int) -> int:
    """The blocks that a key has for ``n`` hashes. Groups of some hundreds to thousands are compared fastest; each further block makes keys longer, groups smaller and rows more."""
    return 1 if n < 1_000_000 else 2 if n < 30_000_000 else 3


def _dealt(reps: DataFrame, blocks: int, agree: int) -> DataFrame:
    """``reps (first, h)`` under each of their keys, groups ``_GROUP`` in one piece and sorted; a key with over ``PART`` members is dealt into parts of which every two are a group."""
    keyed = reps.select("first", "h", F.explode(_block_keys(F.col("h"), blocks, agree)).alias("k")).select("first", "h", "k.*")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.floor((F.col("n") + F.lit(PART - 1)) / PART).cast("int")
    dealt = keyed.join(sizes, ["choice", "bits"]).withColumn("own", F.pmod(F.xxhash64("h"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    # a part meets itself once, and each other part once
    dealt = dealt.select("choice", "bits", "upto", "first", "h", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    # few bytes are much work here, so their tasks are not to be merged by size
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *_GROUP).sortWithinPartitions(*_GROUP, "own")


def _groups(batches):
    """``(first, own, h, choice, upto)`` of the groups of sorted batches, each whole."""

    def of(pdf: pd.DataFrame):
        for (choice, *_), g in pdf.groupby(_GROUP, sort=False):
            yield g["first"].to_numpy(), g["own"].to_numpy(), g["h"].to_numpy(np.int64).view(np.uint64), int(choice), int(g["upto"].iloc[0])

    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf])
        last = (held[_GROUP] == held[_GROUP].iloc[-1]).all(axis=1)
        whole, held = held[~last], held[last]
        yield from of(whole)
    if held is not None:
        yield from of(held)


def hash_classes(hashed: DataFrame, most: int = 9, agree: int | None = None) -> DataFrame:
    """``(id, class_id, n_links)`` of 64-bit hashes ``(id, h)``: the smallest id that can be reached by steps of ``most`` or fewer differing bits, and how many other hashes lie so near.

    Equal hashes are merged before, so copies do not multiply, and null hashes
    are left out. Of ``most + agree`` bit blocks a near pair agrees in ``agree``
    at least, so each hash is filed under every choice of so many. The members
    of a key are compared in one task, which passes on counts and a spanning
    forest, never pairs: at most two rows for each member. A key with over
    ``PART`` members is dealt into parts of which every two meet in a task of
    their own. Without ``agree``, the number of hashes decides; the result is
    the same.
    """
    hashed = hashed.filter("h is not null")
    reps = stored(hashed.groupBy("h").agg(F.min("id").alias("first")))
    agree = agree or _agreeing(reps.count())
    blocks = most + agree

    def walk(batches):
        out = []
        for _, own, h, choice, upto in _groups(batches):
            out += _walked(own, h, choice, upto, blocks, most)
            if len(out) >= 10_000:
                yield of(out)
                out = []
        yield of(out)

    def of(out: list) -> pd.DataFrame:
        h, links, to = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"h": pd.array(h, "Int64"), "links": pd.array(links, "Int64"), "to": pd.array(to, "Int64")})  # no floats: they lose bits

    found = stored(_dealt(reps, blocks, agree).mapInPandas(walk, "h long, links long, to long"))
    links = found.groupBy("h").agg(F.sum("links").alias("n_links"))
    name = reps.select(F.col("h").alias("to"), F.col("first").alias("b"))
    edges = found.filter("to is not null").select("h", "to").distinct().join(reps, "h").join(name, "to").select(F.col("first").alias("a"), "b")
    classes = components(edges).select(F.col("id").alias("first"), F.col("component"))
    told = reps.join(links, "h", "left").join(classes, "first", "left").select("h", F.coalesce("component", "first").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return hashed.join(told, "h").select("id", "class_id", "n_links")


def hash_pairs(hashed: DataFrame, most: int = 9, agree: int | None = None) -> DataFrame:
    """``(a, b, distance)`` of 64-bit hashes ``(id, h)`` at ``most`` or fewer differing bits, between representatives.

    Equal hashes are merged before (``hash_members``), so copies do not
    multiply. Hashes meet as in ``hash_classes``; every pair is found, once, at
    its first common choice. A task holds one group, and passes pairs on as it
    finds them.
    """
    reps = stored(hashed.filter("h is not null").groupBy("h").agg(F.min("id").alias("first")))
    agree = agree or _agreeing(reps.count())
    blocks = most + agree

    def walk(batches):
        out, n = [], 0
        for ids, own, h, choice, upto in _groups(batches):
            for i, _, first in _near(own, h, choice, upto, blocks, most):
                if len(first):
                    out.append((np.repeat(ids[i : i + 1], len(first)), ids[first], np.bitwise_count(h[first] ^ h[i])))
                    n += len(first)
                if n >= 10_000:
                    yield of(out)
                    out, n = [], 0
        if out:
            yield of(out)

    def of(out: list) -> pd.DataFrame:
        a, b, distance = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"a": a, "b": b, "distance": distance.astype(np.int32)})

    kind = reps.schema["first"].dataType.simpleString()
    pairs = _dealt(reps.filter("first is not null"), blocks, agree).mapInPandas(walk, f"a {kind}, b {kind}, distance int")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").filter("a < b")


def hash_members(hashed: DataFrame) -> DataFrame:
    """``(id, representative)``: the smallest id with the same hash."""
    return hashed.join(hashed.groupBy("h").agg(F.min("id").alias("representative")), "h").select("id", "representative")


#: So many known templates at most are compared in the row; more are met by blocks.
FEW_TEMPLATES = 2000


def template_findings(hashed: DataFrame, templates: DataFrame, most: int = 9, agree: int = 3) -> DataFrame:
    """``known_phishing_template`` for each image ``(id, h)`` at ``most`` or fewer bits from a hash of the user's table ``templates (h)``."""
    known = templates.select("h").distinct()
    few = [r[0] for r in known.limit(FEW_TEMPLATES + 1).collect()]
    if len(few) <= FEW_TEMPLATES:
        near = F.exists(F.array(*(F.lit(x) for x in few)).cast("array<bigint>"), lambda t: X.hamming(t, F.col("h")) <= most) if few else F.lit(False)
        found = hashed.filter(near).select("id")
    else:
        keyed = lambda df: df.select("*", F.explode(_block_keys(F.col("h"), most + agree, agree)).alias("k")).select(*df.columns, "k.choice", "k.bits")
        other = keyed(known).select(F.col("h").alias("ht"), "choice", "bits")
        found = keyed(hashed.select("id", "h")).join(other, ["choice", "bits"]).filter(X.hamming(F.col("h"), F.col("ht")) <= most).select("id").distinct()
    return found.select("id", F.lit(900).alias("ord"), F.lit("known_phishing_template").alias("finding"))
