"""Files as documents: size limits, type by magic bytes, text, DOCX parts, metadata."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.operators import copying, semantic
from lexloom.operators.metadata import iso_date, pdf_date, suspicion, xml_tag
from lexloom.operators.metrics import not_yet_stored
from lexloom.sources.pdf import read_pdf
from lexloom.sources.tables import KeyedTable
from lexloom.storage import stored

PDF, DOCX, TXT = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain"
#: Bytes in which a NUL speaks against plain text.
SNIFFED = 8000
#: First bytes, in hexadecimal, of files that aren't text: ZIP, PNG, GIF, JPEG, GZIP, RTF, PostScript, old Office.
OTHER_TYPES = ("504B0304", "89504E47", "47494638", "FFD8FF", "1F8B", "7B5C727466", "25215053", "D0CF11E0")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, modificationTime, length, content; as a stream, new files as they appear."""
    if stream:
        schema = "path string, modificationTime timestamp, length long, content binary"
        return spark.readStream.format("binaryFile").schema(schema).load(path)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def within_limits(files: DataFrame, config: EngineConfig = EngineConfig(), corpus: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected). The business limit holds for submitted documents, not for the corpus."""
    most = config.hard_file_mb if corpus else min(config.max_file_mb, config.hard_file_mb)
    fits = F.col("length") <= most * 1024 * 1024
    return files.filter(fits), files.filter(~fits).select("path", "length", F.lit("FILE_TOO_LARGE").alias("error"))


def mime(path: Column, content: Column, declared: Column | None = None) -> Column:
    """PDF and DOCX by what they hold; text by a missing NUL and the name or the declared type, if no
    other type is seen; null: not accepted."""
    head = F.hex(F.substring(content, 1, SNIFFED))
    word = F.contains(content, F.lit(b"word/document.xml"))
    other = F.lit(False)
    for magic in OTHER_TYPES:
        other = other | head.startswith(magic)
    named = F.lower(path).endswith(".txt")
    named = named if declared is None else named | F.coalesce(declared == TXT, F.lit(False))
    return F.when(head.startswith("25504446"), PDF).when(head.startswith("504B0304") & word, DOCX).when(~other & named & ~head.rlike("^(?:..)*?00"), TXT)


def docx_parts(content: Column) -> Column:
    """document, core and app XML, raw text of a DOCX; nulls where it can't be read."""

    @F.pandas_udf("document string, core string, app string, text string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(data) -> tuple:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = set(z.namelist())
                    document, core, app = (z.read(n).decode("utf-8", "replace") if n in names else None for n in ("word/document.xml", "docProps/core.xml", "docProps/app.xml"))
                root = ElementTree.fromstring(document)
                text = "\n\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
                return document, core, app, text
            except (zipfile.BadZipFile, ElementTree.ParseError, TypeError, KeyError):
                return None, None, None, None

        for p in parts:
            yield pd.DataFrame([one(x) for x in p], columns=["document", "core", "app", "text"])

    return run(content)


def needs_ocr(kind: Column, text: Column, pages: Column, config: EngineConfig = EngineConfig()) -> Column:
    """A PDF with little text a page."""
    if not config.ocr:
        return F.lit(False)
    return (kind == PDF) & (pages > 0) & (F.length(F.trim(F.coalesce(text, F.lit("")))) / pages < config.ocr_least_chars_a_page)


def joined_pages(pages: Column) -> Column:
    return F.array_join(pages, "\n\n")


def pdf_info(content: Column) -> Column:
    """author, producer, creator, created, modified, as written in a PDF's document information."""
    return read_pdf(content)["info"]


def extract(files: DataFrame, config: EngineConfig = EngineConfig(), pdf=None, ocr=None) -> DataFrame:
    """path, content_hash, mime, text, xml, core, app, info, error, pages. A column `declared` of
    `files` is the type that the sender named.

    pdf: Column builder from content to (text, pages) in place of `sources.pdf`; ocr: from content to
    an array of pages' texts, for PDFs with little text (null: failed, the text stays). A PDF that
    can't be read has its reason as the error. A byte order mark stays in text.
    """
    found = files.select("path", "content", F.sha2("content", 256).alias("content_hash"), mime(F.col("path"), F.col("content"), F.col("declared") if "declared" in files.columns else None).alias("mime"))
    is_docx = F.col("mime") == DOCX
    found = found.withColumn("docx", docx_parts(F.when(is_docx, F.col("content"))))
    text = F.when(F.col("mime") == TXT, F.make_valid_utf8(F.col("content").cast("string"))).when(is_docx, F.col("docx.text"))
    found = found.withColumn("pdf", (pdf or read_pdf)(F.when(F.col("mime") == PDF, F.col("content"))))
    text = F.coalesce(text, F.col("pdf.text"))
    if ocr is not None:
        wanted = needs_ocr(F.col("mime"), F.col("pdf.text"), F.col("pdf.pages"), config)
        text = F.when(wanted, F.coalesce(joined_pages(ocr(F.col("content"))), text)).otherwise(text)
    info, reason = (F.col("pdf.info"), F.col("pdf.error")) if pdf is None else (pdf_info(F.when(F.col("mime") == PDF, F.col("content"))), F.lit(None).cast("string"))
    error = F.when(F.col("mime").isNull(), "UNSUPPORTED_TYPE").when(text.isNull(), F.coalesce(reason, F.lit("NO_TEXT")))
    return found.select("path", "content_hash", "mime", text.alias("text"), F.col("docx.document").alias("xml"), F.col("docx.core").alias("core"), F.col("docx.app").alias("app"), info.alias("info"), error.alias("error"), F.col("pdf.pages").cast("int").alias("pages"))


def docx_metadata(extracted: DataFrame) -> DataFrame:
    """path, author, last_modified_by, created, modified, software, from the parts of a DOCX."""
    core, app = F.col("core"), F.col("app")
    return extracted.select("path", xml_tag(core, "dc:creator").alias("author"), xml_tag(core, "cp:lastModifiedBy").alias("last_modified_by"),
                            iso_date(xml_tag(core, "dcterms:created")).alias("created"), iso_date(xml_tag(core, "dcterms:modified")).alias("modified"), xml_tag(app, "Application").alias("software"))


def file_metadata(extracted: DataFrame, as_of: Column) -> DataFrame:
    """path, created, modified, author, producer, suspicious, suspicion_note of PDF and DOCX files.

    as_of: when the files were submitted. Files of other types have no row.
    """
    core, app, info = F.col("core"), F.col("app"), F.col("info")
    is_pdf = F.col("mime") == PDF
    rows = extracted.filter(F.col("mime").isin(PDF, DOCX)).select(
        "path", F.when(is_pdf, pdf_date(info["created"])).otherwise(iso_date(xml_tag(core, "dcterms:created"))).alias("created"),
        F.when(is_pdf, pdf_date(info["modified"])).otherwise(iso_date(xml_tag(core, "dcterms:modified"))).alias("modified"),
        F.when(is_pdf, info["author"]).otherwise(xml_tag(core, "dc:creator")).alias("author"),
        F.when(is_pdf, F.coalesce(info["producer"], info["creator"])).otherwise(xml_tag(app, "Application")).alias("producer"))
    why = suspicion(F.col("created"), F.col("modified"), as_of)
    return rows.withColumns({"suspicious": F.coalesce(F.size(why) > 0, F.lit(False)), "suspicion_note": F.get(why, F.lit(0))})


def write_tables(frames: dict[str, DataFrame], folder: str, key: str = "doc_id") -> None:
    """Replaces the rows of each frame's keys in a keyed table of its name; a run again changes nothing."""
    for name, df in frames.items():
        replace_rows(df, f"{folder}/{name}", key)


def replace_rows(rows: DataFrame, folder: str, key: str = "doc_id", keys: DataFrame | None = None) -> None:
    """Replaces what the keyed table in `folder` has of each key with `rows`, in one step; see KeyedTable."""
    KeyedTable(rows.sparkSession, folder, key).replace(rows, keys)


def read_table(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame | None:
    """The rows of a keyed table as they were last committed; null where there is none."""
    return KeyedTable(spark, folder, key).read()


def add_corpus(sources: DataFrame, folder: str, config: EngineConfig = EngineConfig(), embedder=None) -> None:
    """Adds sources (doc_id, title, source_url, text) to the corpus in `folder`, with their shingles,
    LSH buckets and, if an embedder is given, sentence vectors; contents that it has are passed over.

    Documents are written last, so that a run that broke off is done again whole.
    """
    spark = sources.sparkSession
    hashed = sources.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = read_table(spark, f"{folder}/documents")
    known = hashed.select("content_hash").limit(0) if known is None else known.select("content_hash")
    fresh = stored(hashed.join(not_yet_stored(sources, known), ["doc_id", "content_hash"], "left_semi"), "corpus")
    replace_rows(copying.shingle_table(fresh, config), f"{folder}/shingles")
    replace_rows(copying.buckets(fresh, config).withColumnRenamed("doc_id", "corpus_doc_id"), f"{folder}/lsh", "corpus_doc_id")
    if embedder is not None:
        replace_rows(semantic.sentence_vectors(fresh, embedder), f"{folder}/sentences")
    replace_rows(fresh, f"{folder}/documents")
