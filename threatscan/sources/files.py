"""File sources: dispatch by extension, rejects, and exploders of containers, messages and office texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatscan.rules import documents as R

def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "true").load(path).withColumn("id", F.col("image.origin"))


def supported_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.FORMATS, "extension string, format string, description string").orderBy("extension")


def extension(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def dispatch(files: DataFrame) -> DataFrame:
    """``files (path, length)`` with ``extension``, ``format`` and ``reject_reason`` (null: can be scanned). The registry is a constant of a few rows."""
    known = F.create_map(*(F.lit(x) for e, f, _ in R.FORMATS for x in (e, f)))
    out = files.withColumn("extension", extension(F.col("path"))).withColumn("format", known[F.col("extension")])
    reason = F.when(F.coalesce("path", F.lit("")) == "", "missing_name").when(F.coalesce("length", F.lit(0)) == 0, "empty").when(F.col("format").isNull(), "unsupported")
    return out.withColumn("reject_reason", reason)


def size_label(length):
    return F.format_string("%.2f KB", F.bround(length / 1024, 2))


def mail_rejects(files: DataFrame) -> DataFrame:
    return files.withColumn("reject_reason", F.when(extension(F.col("path")) != ".eml", "not_eml").when(F.col("length") == 0, "empty"))


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    """The ``.eml`` files below ``path`` as ``messages`` has them, with ``path``; empty ones have a ``reject_reason``."""
    files = mail_rejects(read_files(spark, path, "*.eml"))
    return messages(files).join(files.select(F.col("path").alias("id"), "reject_reason"), "id").withColumn("path", F.col("id"))


def ooxml_parts(files: DataFrame, key: str = "path", part_bytes: int | None = None, file_bytes: int | None = None) -> DataFrame:
    """The parts of ZIP containers ``(key, content)`` as ``(id, entry_ord, entry_name, data, error)``; a bad container is one row with an error.

    All parts are unpacked, one by one. Against containers that unpack to far
    more than their size a caller may set limits: a part beyond ``part_bytes``,
    or beyond ``file_bytes`` together with those before it, then has an error
    for its data.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf[key], pdf["content"], strict=True):
                rows, total = [], 0
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for i, info in enumerate(z.infolist()):
                            total += info.file_size
                            if (part_bytes is not None and info.file_size > part_bytes) or (file_bytes is not None and total > file_bytes):
                                rows.append((name, i, info.filename, None, "too large"))
                                continue
                            try:
                                rows.append((name, i, info.filename, z.read(info), None))
                            except Exception as e:  # a broken part; the others still count
                                rows.append((name, i, info.filename, None, str(e)))
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    rows.append((name, -1, None, None, f"bad container: {e}"))
                yield pd.DataFrame(rows, columns=["id", "entry_ord", "entry_name", "data", "error"])

    return files.select(key, "content").mapInPandas(explode, "id string, entry_ord int, entry_name string, data binary, error string")


def messages(files: DataFrame, key: str = "path") -> DataFrame:
    """MIME messages ``(key, content)`` as headers, bodies, attachment names and the columns that ``scan_mail`` reads."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf[key], pdf["content"], strict=True):
                headers, text, html, files_, error = {}, "", "", [], None
                try:
                    m = message_from_bytes(content or b"", policy=policy.default)
                    for k, v in m.items():
                        headers.setdefault(k.lower(), []).append(str(v))
                    for p in m.walk():
                        if p.is_multipart():
                            continue
                        if p.get_filename():
                            files_.append(p.get_filename())
                        elif p.get_content_type() == "text/plain":
                            text += p.get_content()
                        elif p.get_content_type() == "text/html":
                            html += p.get_content()
                except Exception as e:  # a broken message is a row with an error
                    error = str(e)
                one = lambda h: " ".join(headers.get(h, [])) or None  # noqa: B023, E731
                rows.append((name, headers, text, html, files_, one("authentication-results"), one("received-spf"), one("from"), one("reply-to"), error))
            yield pd.DataFrame(rows, columns=["id", "headers", "text_body", "html_body", "attachments", "auth", "spf_header", "sender", "reply_to", "error"])

    return files.select(key, "content").mapInPandas(parse, "id string, headers map<string,array<string>>, text_body string, html_body string, attachments array<string>, auth string, spf_header string, sender string, reply_to string, error string")


def office_text(parts: DataFrame) -> DataFrame:
    """``(id, text)``: the words of documents, slides and shared strings of each container."""
    x = F.make_valid_utf8(F.col("data").cast("string"))
    wanted = parts.filter(F.col("entry_name").rlike(r"^word/document\.xml$|^ppt/slides/slide\d+\.xml$|^xl/sharedStrings\.xml$|^xl/worksheets/.*\.xml$") & F.col("error").isNull())
    found = wanted.select("id", "entry_ord", F.array_join(F.regexp_extract_all(x, F.lit(r"<(?:w:t|a:t|t)(?:\s[^>]*)?>([^<]*)</"), F.lit(1)), " ").alias("t"))
    return found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_ord", "t"))), lambda s: s["t"]), " ").alias("text"))


def workbook_cells(parts: DataFrame) -> DataFrame:
    """``(id, sheet, ref, value)``: formulas (with ``=``), inline values and shared strings of workbooks, joined by string index."""
    cell = r'<c r="([A-Z]+\d+)"([^>]*)>(.*?)</c>'
    sheets = parts.filter(F.col("entry_name").rlike(r"^xl/worksheets/[^/]*\.xml$") & F.col("error").isNull()).select("id", F.col("entry_name").alias("sheet"), F.explode(F.regexp_extract_all(F.make_valid_utf8(F.col("data").cast("string")), F.lit(f"(?s)({cell})"), F.lit(1))).alias("c"))
    get = lambda g: F.regexp_extract("c", f"(?s){cell}", g)
    cells = sheets.select("id", "sheet", get(1).alias("ref"), get(2).contains('t="s"').alias("shared"), F.regexp_extract("c", "(?s)<f[^>]*>(.*?)</f>", 1).alias("f"), F.regexp_extract("c", "(?s)<v>(.*?)</v>", 1).alias("v"))
    strings = parts.filter("entry_name = 'xl/sharedStrings.xml' and error is null").select("id", F.posexplode(F.regexp_extract_all(F.make_valid_utf8(F.col("data").cast("string")), F.lit("(?s)<si>(.*?)</si>"), F.lit(1))).alias("i", "s")).select(F.col("id").alias("book"), "i", F.regexp_replace("s", "<[^>]+>", "").alias("s"))
    met = cells.join(strings, (F.col("id") == F.col("book")) & F.col("shared") & (F.expr("try_cast(v AS int)") == F.col("i")), "left")
    return met.select("id", "sheet", "ref", F.when(F.col("f") != "", F.concat(F.lit("="), "f")).otherwise(F.coalesce("s", "v")).alias("value"))


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results partitioned by verdict."""
    df.write.mode("append").partitionBy("verdict").format(fmt).save(path)


def result_rows(df: DataFrame, kind: str) -> DataFrame:
    """Results of one kind as ``(type, id, score, verdict)``, verdicts in one spelling."""
    return df.select(F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"), F.col("score").cast("int").alias("score"), F.initcap(F.lower("verdict")).alias("verdict"))


def write_batch(df: DataFrame, path: str, kind: str, run: str, batch: int) -> None:
    """Results of one kind as the folder of (kind, run, batch), in place of what is there: a batch that is written again leaves the same table."""
    result_rows(df, kind).drop("type").write.mode("overwrite").parquet(f"{path}/type={kind}/run={run}/batch={int(batch)}")


def sink(path: str, kind: str, run: str):
    """A function for ``foreachBatch`` that writes each batch of results by ``write_batch``. ``run`` names the query: one name as long as its checkpoint lives."""

    def put(batch: DataFrame, number: int) -> None:
        write_batch(batch, path, kind, run, number)

    return put


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The results of all kinds and runs below ``path``: ``(type, run, batch, id, score, verdict)``."""
    out = spark.read.schema("id string, score int, verdict string, type string, run string, batch long").parquet(path)
    return out.select("type", "run", "batch", "id", "score", "verdict")


def part_errors(parts: DataFrame) -> DataFrame:
    """``(id, errors)``: what could not be read in each container, as (part, error) in order; only containers with errors. Findings of the other parts are not touched."""
    bad = parts.filter("error is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("entry_ord", F.col("entry_name").alias("part"), "error"))).alias("e"))
    return bad.select("id", F.transform("e", lambda x: F.struct(x["part"].alias("part"), x["error"].alias("error"))).alias("errors"))


def history(urls: DataFrame, documents: DataFrame, mails: DataFrame) -> DataFrame:
    """One table ``(type, id, score, verdict)`` of all kinds of results."""
    return result_rows(urls, "url").unionByName(result_rows(documents, "document")).unionByName(result_rows(mails, "email"))
