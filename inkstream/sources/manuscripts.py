"""Sources of manuscripts: text, Markdown, HTML, EPUB and PDF files, tables of pages, and a router over them.

Each gives ``doc_id, title, author, source_type, metadata, raw_text``; ids number the
files by path. Files are read by Spark's own readers, so any file system works.
"""

from __future__ import annotations

import io
import re
import urllib.request
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkstream.functions import text as T
from inkstream.functions.html import AUTHOR, parse_html, read_page

TITLE_DEFAULT = "Untitled Manuscript"
COLUMNS = ["doc_id", "title", "author", "source_type", "metadata", "raw_text"]
NO_METADATA = "cast(map() as map<string,string>)"
KINDS = {".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".pdf": "pdf", ".epub": "epub"}


def _shape(df: DataFrame, title: Column, author: Column, kind: str, text: Column, metadata: Column | None = None) -> DataFrame:
    return df.select("doc_id", title.alias("title"), author.alias("author"), F.lit(kind).alias("source_type"), (F.expr(NO_METADATA) if metadata is None else metadata).alias("metadata"), text.alias("raw_text"))


def from_table(df: DataFrame, id_col: str, text_col: str, title: str = TITLE_DEFAULT, author: str = AUTHOR) -> DataFrame:
    """Text that a table already holds."""
    return _shape(df.withColumn("doc_id", F.col(id_col)), F.lit(title), F.lit(author), "TEXT", F.col(text_col))


def from_string(spark: SparkSession, text: str, title: str = TITLE_DEFAULT, author: str = AUTHOR) -> DataFrame:
    return from_table(spark.createDataFrame([(0, text)], "doc_id long, text string"), "doc_id", "text", title, author)


@F.pandas_udf(StringType())
def _decode_bytes(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "replace"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with bad bytes replaced; ids are hashes of their paths."""
    read = spark.read.format("binaryFile").load(path)
    return read.select(F.xxhash64("path").alias("doc_id"), "path", _decode_bytes("content").alias("text"))


def from_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain text; the title comes from the file's name."""
    return _shape(_files(spark, path), T.file_title(F.col("path")), F.lit(AUTHOR), "TEXT", F.col("text"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """Metadata of ``key: value`` lines between leading ``---`` marks, and the text after them."""
    parts = F.split(text, "---", 3)
    has = text.startswith("---") & (F.size(parts) >= 3)
    lines = F.filter(F.split(F.element_at(parts, 2), r"\r\n|\r|\n"), lambda x: F.instr(x, ":") > 0)
    key = lambda x: F.lower(T.strip(F.substring_index(x, ":", 1)))
    value = lambda x: T.sub(T.sub(T.strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))), '\\A"+|"+\\z', ""), "\\A'+|'+\\z", "")
    pairs = F.transform(lines, lambda x, i: F.struct(key(x).alias("k"), value(x).alias("v"), i.alias("i")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    found = F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))
    return F.when(has, found).otherwise(F.expr(NO_METADATA)), F.when(has, F.element_at(parts, 3)).otherwise(text)


def from_markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown with optional front matter, whose title and author win."""
    meta, body = front_matter(F.col("text"))
    files = _files(spark, path).withColumns({"meta": meta, "body": body})
    return _shape(files, F.coalesce(F.col("meta")["title"], T.file_title(F.col("path"))), F.coalesce(F.col("meta")["author"], F.lit(AUTHOR)), "MARKDOWN", F.col("body"), F.col("meta"))


def from_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Pages of a table, read structurally; with urls they count as fetched from the web."""
    read = df.select(F.col(id_col).alias("doc_id"), *([F.col(url_col).alias("url")] if url_col else []), parse_html(F.coalesce(F.col(html_col), F.lit(""))).alias("p"))
    meta = F.when(F.col("url").isNotNull(), F.create_map(F.lit("url"), F.col("url"))).otherwise(F.expr(NO_METADATA)) if url_col else None
    return _shape(read, F.col("p.title"), F.col("p.author"), "WEB_URL" if url_col else "HTML", F.col("p.prose"), meta)


def from_html_files(spark: SparkSession, path: str) -> DataFrame:
    return from_pages(_files(spark, path), "doc_id", "text", None)


def from_url(spark: SparkSession, url: str, timeout: float = 15.0) -> DataFrame:
    """One page fetched by the driver."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as answer:  # noqa: S310
        html = answer.read().decode("utf-8", "replace")
    return from_pages(spark.createDataFrame([(0, url, html)], "page_id long, url string, html string"))


def epub_prose(data: bytes) -> str:
    """The pages of an EPUB in order of their names, as one manuscript."""
    out, n = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            if name.endswith((".xhtml", ".html", ".htm")):
                prose = read_page(z.read(name).decode("utf-8", "replace"))[2]
                if prose.strip():
                    n += 1
                    out.append(prose if re.search(r"(?m)^#", prose) else f"# Section {n}\n\n{prose}")
    return "\n\n".join(out)


def pdf_prose(data: bytes) -> str:
    """The text of a PDF's pages; what goes wrong is told in the text."""
    try:
        from pypdf import PdfReader

        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
        return "\n\n".join(p for p in pages if p.strip())
    except Exception as e:
        return f"PDF text extraction failed: {e}"


@F.pandas_udf(StringType())
def _epub(content: pd.Series) -> pd.Series:
    return content.map(lambda b: epub_prose(bytes(b)))


@F.pandas_udf(StringType())
def _pdf(content: pd.Series) -> pd.Series:
    return content.map(lambda b: pdf_prose(bytes(b)))


def from_epub_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", _epub("content").alias("text"))
    return _shape(files, T.file_title(F.col("path")), F.lit("Unknown"), "EPUB", F.col("text"))


def from_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", _pdf("content").alias("text"))
    return _shape(files, T.file_title(F.col("path")), F.lit(AUTHOR), "TEXT", F.col("text"))


def route(spark: SparkSession, target: str) -> DataFrame:
    """The source a target names: a web address, a file by its extension, else the text itself."""
    if target.startswith(("http://", "https://")):
        return from_url(spark, target)
    if exists(spark, target):
        kind = KINDS.get((re.search(r"\.[^./]*$", target) or [""])[0].lower(), "text")
        return {"markdown": from_markdown_files, "html": from_html_files, "pdf": from_pdf_files, "epub": from_epub_files, "text": from_text_files}[kind](spark, target)
    return from_string(spark, target)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path names a file on any file system that Spark knows."""
    if "\n" in path or len(path) > 4096 or not path.strip():
        return False
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
    except Exception:
        return False


def from_payload(spark: SparkSession, payload: dict) -> DataFrame:
    """The first of url, file path, uploaded file (base64) and text that a request holds."""
    import base64

    if payload.get("url"):
        return from_url(spark, payload["url"])
    if payload.get("file_path"):
        if not exists(spark, payload["file_path"]):
            raise FileNotFoundError(payload["file_path"])
        return route(spark, payload["file_path"])
    if payload.get("file_base64"):
        data, name = base64.b64decode(payload["file_base64"]), payload.get("filename", "upload.txt")
        kind = KINDS.get((re.search(r"\.[^./]*$", name) or [""])[0].lower(), "text")
        if kind == "html":
            return from_pages(spark.createDataFrame([(0, data.decode("utf-8", "replace"))], "doc_id long, text string"), "doc_id", "text", None)
        text = {"epub": epub_prose, "pdf": pdf_prose}.get(kind, lambda b: b.decode("utf-8", "replace"))(data)
        return from_string(spark, text, payload.get("title") or TITLE_DEFAULT, payload.get("author") or AUTHOR)
    return from_string(spark, payload.get("text") or "", payload.get("title") or TITLE_DEFAULT, payload.get("author") or AUTHOR)
