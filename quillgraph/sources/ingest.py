"""Ingest: files and tables of text to documents(doc_id, path, title, text).

Workers decode text, DOCX from its zip, and PDF by a function that the caller has, from bytes
to a list of pages of text items; simple_pdf_pages is one for the plainest files.
"""

from __future__ import annotations

import io
import mimetypes
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, file_extension, file_title, trim_ws
from ..session import saved, ship_package

TEXT_EXTENSIONS = ("txt", "md")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TYPES = mimetypes.MimeTypes()  # Python's own table, not the machine's
PdfDecoder = Callable[[bytes], Sequence[Sequence[str]]]


def _is_text(extension: str) -> bool:
    """True for extensions of a text/* type, such as html, csv or css."""
    return (_TYPES.guess_type(f"x.{extension}")[0] or "").startswith("text/")


def docx_text(content: bytes) -> str:
    """Raw text of the body: tabs and line breaks kept, a blank line after each paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    paragraphs = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for node in p.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        paragraphs.append("".join(parts))
    return "".join(f"{p}\n\n" for p in paragraphs)


_PDF_OBJECT = re.compile(rb"(?s)(?<!\d)(\d+) 0 obj\s*(<<.*?)endobj")
_PDF_SHOWN = re.compile(rb"\(([^()\\]*)\)\s*Tj")
_PDF_OTHER = re.compile(rb"(?<!\w)(?:Tj|TJ|Do|EI)(?!\w)|[)>\]\d]\s*['\"]")  # all else that shows something


def simple_pdf_pages(content: bytes) -> list[list[str]]:
    """Pages of a simple PDF, each as its shown strings: one content a page, plain or deflated, pages in a flat list, strings in Windows-1252.

    Any other file is an error, never part of its text; it needs a decoder of the caller's.
    """
    objects = {int(m[1]): m[2] for m in _PDF_OBJECT.finditer(content)}
    kids = [re.search(rb"/Kids\s*\[([\d R]*)\]", o) for o in objects.values() if b"/Type /Pages" in o]
    if len(kids) != 1 or kids[0] is None:
        raise ValueError("this is no PDF file with a flat list of pages")
    pages = []
    for page in re.findall(rb"(\d+) 0 R", kids[0][1]):
        at = re.search(rb"/Contents (\d+) 0 R", objects[int(page)])
        head, found, data = objects[int(at[1])].partition(b"stream\n") if at else (b"", b"", b"")
        filters = re.findall(rb"/Filter\s*(\S+)", head)
        if not found or filters not in ([], [b"/FlateDecode"]):
            raise ValueError("a page of this PDF file has no single content that is plain or deflated")
        data = data.rpartition(b"\nendstream")[0]
        data = zlib.decompress(data) if filters else data
        shown = _PDF_SHOWN.findall(data)
        if _PDF_OTHER.search(_PDF_SHOWN.sub(b"", data)):
            raise ValueError("a page of this PDF file shows more than plain strings")
        pages.append([s.decode("cp1252") for s in shown])
    return pages


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text) from pages(doc_id, page, items array<string>): items joined by blanks, white space collapsed, empty pages out, a blank line between."""
    text = trim_ws(collapse_ws(F.array_join("items", " ")))
    kept = pages.select("doc_id", "page", text.alias("t")).withColumn("t", F.nullif("t", F.lit("")))
    joined = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("page", "t")))).alias("p"))
    return joined.select("doc_id", F.array_join("p.t", "\n\n").alias("text"))


def _decoded(files: DataFrame, text_extensions: Sequence[str], pdf: PdfDecoder | None) -> DataFrame:
    """(path, text, error) of files(path, content), decoded where they are read."""
    kinds = files.select("path", "content").withColumn("ext", file_extension("path"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for ext, content in zip(batch["ext"].to_pylist(), batch["content"].to_pylist(), strict=True):
                text = error = None
                try:
                    if ext == "docx":
                        text = docx_text(content)
                    elif ext == "pdf" and pdf is not None:
                        pages = [" ".join(" ".join(items).split()) for items in pdf(content)]
                        text = "\n\n".join(p for p in pages if p)
                    elif ext in text_extensions or _is_text(ext):
                        text = content.decode("utf-8", "replace").removeprefix("\ufeff")
                    elif ext == "pdf":
                        error = "PDF needs a decoder"
                    else:
                        error = f"there is no reader for {ext or 'nameless'} files"
                except Exception as e:  # noqa: BLE001  one bad file is reported, not fatal
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.record_batch([batch["path"], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return kinds.mapInArrow(decode, "path string, text string, error string")


def read_files(spark: SparkSession, path: str | list[str], *, text_extensions: Sequence[str] = TEXT_EXTENSIONS, pdf: PdfDecoder | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, path, title, text) and errors(path, error) of the files under a path.

    doc_id is a hash of the path. Files with text_extensions and of text/* types are text.
    Files of other types, and files that can't be decoded, are errors; with strict=True the
    first of them fails the job. Files are decoded once, into the shared folder, unless strict.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = _decoded(files, text_extensions, pdf)
    if strict:
        read = read.withColumn("text", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("text")))
    else:
        read = saved(read, "files")
    docs = read.filter("text IS NOT NULL").select(F.xxhash64("path").alias("doc_id"), "path", file_title("path").alias("title"), "text")
    return docs, read.filter("error IS NOT NULL").select("path", "error")


def stream_files(spark: SparkSession, path: str, *, text_extensions: Sequence[str] = TEXT_EXTENSIONS, pdf: PdfDecoder | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (doc_id, path, title, text, error): each file under a folder once, as it arrives, decoded where it is read.

    A file that can't be decoded is a row with its error and no text. What was taken is kept
    in the checkpoint of the query that reads the stream; a file that is changed under its old name
    is not taken again. Spark passes over files without a byte.
    """
    ship_package(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    read = _decoded(files, text_extensions, pdf)
    return read.select(F.xxhash64("path").alias("doc_id"), "path", file_title("path").alias("title"), "text", "error")


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """documents of plain text files alone, decoded in the JVM."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", file_title("path").alias("title"), "text")


def pasted(texts: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """documents of texts(doc_id, text[, title]) with text in them, and errors(doc_id, error) for the blank ones."""
    if "title" not in texts.columns:
        texts = texts.withColumn("title", F.lit(None).cast("string"))
    blank = F.coalesce(trim_ws("text"), F.lit("")) == ""
    error = F.lit("the text is blank")
    if strict:
        texts = texts.withColumn("text", F.when(blank, F.raise_error(error)).otherwise(F.col("text")))
        return texts.select("doc_id", "title", "text"), texts.limit(0).select("doc_id", error.alias("error"))
    return texts.filter(~blank).select("doc_id", "title", "text"), texts.filter(blank).select("doc_id", error.alias("error"))


def sample_documents(spark: SparkSession) -> DataFrame:
    """A document of three paragraphs to try things on."""
    text = (
        "The Harbour Museum was founded in 1911 by Clara Benning. Clara Benning gave the museum her collection of sea charts.\n\n"
        "In 1954 the Harbour Museum moved to Pier Four. The city of Oxmouth paid for the new building.\n\n"
        "Today the museum keeps nine thousand charts. The Oxmouth Society publishes a catalogue of the charts every year."
    )
    return spark.createDataFrame([(0, None, text)], "doc_id long, title string, text string")
