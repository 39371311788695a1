"""One call from files to scores: analyzers by format, phrases, URLs, implied findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatscan.functions.tables import stored
from threatscan.operators import documents as D
from threatscan.operators import findings as N
from threatscan.operators.url_findings import anchor_finding_rows, extracted_urls, is_safe, url_finding_rows
from threatscan.sources import files as S

#: format of the registry -> profile of the rules
PROFILES = {"PDF": "pdf", "Word": "docx", "Excel": "xlsx", "PowerPoint": "pptx", "Image": "image"}
OFFICE = ("docx", "xlsx", "pptx")


def _text_findings(texts: DataFrame, profile: str) -> DataFrame:
    """Phrases and URLs of ``texts (id, text)``."""
    urls = texts.select("id", F.explode(extracted_urls(F.col("text"))).alias("url")).filter(~is_safe(F.col("url")))
    return N.phrase_findings(texts, profile).unionByName(url_finding_rows(urls, profile))


def document_findings(files: DataFrame, more: dict[str, DataFrame] | None = None, phase: str = "full", clauses: DataFrame | None = None) -> DataFrame:
    """``(id, profile, ord, finding)`` of ``files (id, path, length, content)``, each by the analyzers of its format.

    Files that cannot be scanned (``dispatch``) have no rows. ``more`` brings
    tables that other tools make, each with the file's ``id``: ``macros (id,
    code)``, ``pages`` and ``links`` of PDF files and workbooks, ``images`` as
    ``image_findings`` reads them, ``templates (h)`` with ``hashes (id, h)``.
    A function registered as ``analyzer("docx:notes")`` gets the table ``more["docx:notes"]``
    and gives further findings of that format. Containers are unpacked once, into a stored table. Rows that share an id
    are one document. ``clauses`` takes the place of the stock chains
    (``findings.chain_table``, with the user's own rows).
    """
    return _scanned(files, more, phase, clauses)[0]


def _scanned(files: DataFrame, more: dict[str, DataFrame] | None, phase: str, clauses: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The findings, and ``(id, errors)`` of what could not be read."""
    more = more or {}
    known = S.dispatch(files).filter("reject_reason is null")
    profile = F.create_map(*(F.lit(x) for kv in PROFILES.items() for x in kv))[F.col("format")]
    names = stored(known.select("id", "path", profile.alias("profile")))
    is_ = lambda p: F.col("profile") == p
    of = lambda df, p: df.join(names.filter(is_(p)).select("id").distinct(), "id", "left_semi")
    parts = stored(S.ooxml_parts(known.filter(profile.isin(*OFFICE)), key="id"))
    office, cells = stored(S.office_text(parts)), S.workbook_cells(parts)
    raw = known.filter(F.col("format") == "PDF").select("id", D.raw_text(F.col("content")).alias("raw"))

    def rows(p: str) -> list[DataFrame]:
        out = []
        own = names.filter(is_(p))
        if p != "pdf":
            out.append(D.file_findings(own, p))
        if p in OFFICE:
            inside = of(parts, p)
            out += [D.part_findings(inside, p), D.metadata_findings(own, inside, p), D.missing_parts(own, inside, p), _text_findings(of(office, p), p)]
            if "macros" in more:
                out.append(D.macro_findings(of(more["macros"], p), p))
        if p == "xlsx":
            out += [D.cell_findings(cells), D.external_links(of(parts, p))]
        if p == "pptx":
            out.append(D.hidden_slides(of(parts, p)))
        if p == "pdf":
            out += [D.pdf_findings(raw), _text_findings(raw.withColumnRenamed("raw", "text"), p)]
            if "pages" in more and "links" in more:
                out.append(D.pdf_page_findings(of(more["pages"], p), of(more["links"], p), anchor_finding_rows(of(more["links"], p), p)))
        if p in ("pdf", "xlsx") and "links" in more:
            out.append(anchor_finding_rows(of(more["links"], p), p))
        if p == "image":
            if "images" in more:
                images = of(more["images"], p)
                out += [D.image_findings(images), _text_findings(images.select("id", F.coalesce("ocr_text", F.lit("")).alias("text")), p)]
            if "hashes" in more and "templates" in more:
                out.append(D.template_findings(of(more["hashes"], p), more["templates"]))
        # the user's own analyzers of this format
        return out + [N.ANALYZERS[n](of(more[n], p)) for n in N.ANALYZERS if n in more and n.partition(":")[0] == p]

    each = []
    for p in PROFILES.values():
        if found := rows(p):
            each.append(reduce(DataFrame.unionByName, (f.select("id", "ord", "finding") for f in found)).withColumn("profile", F.lit(p)))
    found = stored(reduce(DataFrame.unionByName, each))
    errors = S.part_errors(parts)
    if clauses is not None:
        return found.select("id", "profile", "ord", "finding").unionByName(N.implied_findings(found, clauses).select("id", "profile", "ord", "finding")), errors
    implied = [N.chains(found.filter(is_(p)), p, phase=phase).select("id", "ord", "finding", F.lit(p).alias("profile")) for p in N.R.CHAINS]
    return reduce(DataFrame.unionByName, implied, found).select("id", "profile", "ord", "finding"), errors


def scan_documents(files: DataFrame, more: dict[str, DataFrame] | None = None, weights: DataFrame | None = None, phase: str = "full", clauses: DataFrame | None = None) -> DataFrame:
    """``files`` scanned and scored: ``(id, path, size, sha256, reject_reason, score, verdict, severity, total_findings, breakdown, errors)``.

    ``errors`` names the parts of a container that could not be read, or null;
    the findings of the others stand beside them.

    A file without findings scores 0; one that cannot be scanned has a
    ``reject_reason`` and null scores. Other columns of ``files`` are not read.
    """
    found, errors = _scanned(files, more, phase, clauses)
    scores = N.document_scores(N.weighed(found, N.weight_table(files.sparkSession) if weights is None else weights))
    head = S.dispatch(files).select("id", "path", S.size_label(F.col("length")).alias("size"), F.sha2("content", 256).alias("sha256"), "reject_reason")
    met = head.join(scores.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").drop("__id").join(errors, "id", "left")
    scanned = F.col("reject_reason").isNull()

    def shown(c: str, none) -> Column:
        return F.when(scanned, F.coalesce(c, none)).alias(c)

    score = F.when(scanned, F.coalesce("score", F.lit(0)))
    return met.select("id", "path", "size", "sha256", "reject_reason", score.alias("score"), F.when(scanned, N.verdict(F.coalesce("score", F.lit(0)))).alias("verdict"), F.when(scanned, N.risk(F.coalesce("score", F.lit(0)))).alias("severity"), shown("total_findings", F.lit(0).cast("long")), shown("breakdown", F.array().cast(scores.schema["breakdown"].dataType)), "errors")
