"""Files as documents: reject reasons, text formats, archives, manifests, statistics."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab
from ..functions.ordered import in_order
from ..session import written
from . import exports

# Names that systems leave in folders.
SYSTEM_NAMES = (".DS_Store", ".Spotlight-V100", ".Trashes", ".fseventsd", ".localized")


def suffix(path: Column) -> Column:
    """The lower-case extension of a path's last part; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]([.][^./]+)$", 1))


def reject_reason(path: Column, size: Column) -> Column:
    """Why a file is not read, null if it is: system, size, excluded, then hidden or unsupported."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    ext = suffix(path)
    known = ext.isin(*vocab.TEXT_SUFFIXES, *vocab.BINARY_SUFFIXES, *vocab.IMAGE_SUFFIXES)
    return (
        F.when(name.isin(*SYSTEM_NAMES), "system")
        .when(size > vocab.MAX_FILE_BYTES, "size")
        .when(ext.isin(*vocab.EXCLUDED_SUFFIXES), "excluded")
        .when(~known & name.startswith("."), "hidden")
        .when(~known, "unsupported")
    )


def whatsapp(content: Column) -> Column:
    """Whether a text begins like a chat export."""
    return F.substring(content, 1, 2000).rlike(r"(?m)^‎?\[?\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}(:\d{2})?\s*(?i:am|pm)?\]?\s*(-\s*)?[^:\n]+:")


def plain_text(content: Column) -> Column:
    return exports.stripped(F.when(whatsapp(content), F.regexp_replace(F.regexp_replace(content, r"(?m)^.*<Media omitted>.*\n?", ""), "‎", "")).otherwise(content))


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """file_id, source_type, suffix and content of every file under path that reject_reason() lets pass, archives expanded. A file that
    cannot be read is a row too: source_type rejected, and why as its content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = raw.withColumn("reason", reject_reason(F.col("path"), F.col("length"))).filter("reason IS NULL").select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(expanded(p, c)), columns=["file_id", "source_type", "content"])

    return kept.mapInPandas(run, "file_id string, source_type string, content string").withColumn("suffix", suffix(F.col("file_id")))


def _routed(spark: SparkSession, path: str) -> DataFrame:
    """unpacked() by the shape of its chat exports (_kind; none: `other`), unpacked once."""
    rows = unpacked(spark, path)
    known = F.when(F.col("source_type").isin("json", "jsonl"), exports.kind(F.col("content"), F.col("suffix")))
    return written(rows.withColumn("_kind", F.coalesce(known, F.lit("other"))), "unpacked", ["_kind"])


def _documents(rows: DataFrame) -> DataFrame:
    """(file_id, doc_id, source_type, title, date, content) of routed rows."""
    text = F.when(F.col("source_type") == "text", plain_text(F.col("content"))).otherwise(exports.stripped(F.col("content")))
    kind = F.when((F.col("source_type") == "text") & whatsapp(F.col("content")), "whatsapp").otherwise(F.col("source_type"))
    none = F.lit(None).cast("string")
    others = rows.filter((F.col("_kind") == "other") & (F.col("source_type") != "rejected"))
    others = others.select("file_id", F.col("file_id").alias("doc_id"), kind.alias("source_type"), none.alias("title"), none.alias("date"), text.alias("content")).filter("content <> ''")
    return others.unionByName(exports.parsed(rows).select("file_id", "doc_id", "source_type", "title", "date", "content"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """file_id, source_type and content of all accepted text files under path, archives expanded, in file_id order; chat exports and journals
    as the documents that they hold: conversations, sessions, months of a history, entries. JSON of no known shape is text."""
    found = _documents(_routed(spark, path))
    return found.select(F.col("doc_id").alias("file_id"), "source_type", "content").orderBy("file_id")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """file_id and reason of every file under path and of every member of an archive: null if a document came of it, `empty` if it was read and
    held no text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    refused = raw.select(F.col("path").alias("file_id"), reject_reason(F.col("path"), F.col("length")).alias("reason")).filter("reason IS NOT NULL")
    rows = _routed(spark, path)
    read = _documents(rows).select("file_id", F.lit(True).alias("_read")).distinct()
    reason = F.when(F.col("source_type") == "rejected", F.col("content")).when(F.col("_read").isNull(), "empty")
    return refused.unionByName(rows.join(read, "file_id", "left").select("file_id", reason.alias("reason")))


#: Archives within archives that are opened.
NESTED = 8


def expanded(name: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, str, str]]:
    """The documents of a file: archives recursively, names joined by two colons. What cannot be read is (name, rejected, why): damaged,
    nested (archives deeper than NESTED), size (a member too large) or unsupported; other members of its archive are read."""
    try:
        yield from _expanded(name, data, depth)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, NotImplementedError, RuntimeError, EOFError, ValueError, zlib.error):
        yield name, "rejected", "damaged"


def _expanded(name: str, data: bytes, depth: int) -> Iterator[tuple[str, str, str]]:
    ext = re.search(r"(\.[^./]+)?$", name)[0].lower()
    if ext == ".zip" and depth >= NESTED:
        yield name, "rejected", "nested"
    elif ext == ".zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                base = info.filename.rsplit("/", 1)[-1]
                if info.is_dir() or base.startswith("._") or "__MACOSX" in info.filename:
                    continue
                own = f"{name}::{info.filename}"
                if info.file_size > vocab.MAX_FILE_BYTES:
                    yield own, "rejected", "size"
                    continue
                try:
                    member = z.read(info)
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, zlib.error):
                    yield own, "rejected", "damaged"
                    continue
                yield from expanded(own, member, depth + 1)
    elif ext == ".docx":
        yield name, "docx", docx_text(data)
    elif ext in vocab.IMAGE_SUFFIXES:
        yield name, "image", "[image]"  # described later, at the model boundary
    elif ext in vocab.TEXT_SUFFIXES:
        kind = {".md": "markdown", ".markdown": "markdown", ".json": "json", ".jsonl": "jsonl"}.get(ext, "text")
        yield name, kind, data.decode("utf-8", "replace")
    elif ext == ".pdf":
        yield name, "pdf", pdf_text(data)
    else:
        yield name, "rejected", "unsupported"


def docx_text(data: bytes) -> str:
    """Paragraphs with text, a line each."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n".join(x for x in lines if x.strip())


def pdf_text(data: bytes) -> str:
    """Strings shown by uncompressed and deflated content streams, page after page; a full reader is used where one is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        pages = []
        for stream in re.findall(rb"stream\r?\n(.*?)endstream", data, re.S):
            for body in (stream, None):
                try:
                    body = zlib.decompress(stream.strip()) if body is None else body
                except zlib.error:
                    continue
                shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ", body)
                if shown:
                    parts = (a or b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", b)) for a, b in shown)
                    pages.append(" ".join(re.sub(rb"\\(.)", rb"\1", p).decode("latin-1") for p in parts))
                    break
        return "\n\n".join(pages)
    return "\n\n".join(t for p in PdfReader(io.BytesIO(data)).pages if (t := (p.extract_text() or "").strip()))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def upserted(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The manifest (file_path, content_hash, added_at, position) after new (file_path, content_hash) was seen: known paths keep
    added_at and position and take the new hash; new ones follow in path order."""
    o = old.select("file_path", F.col("content_hash").alias("_old"), "added_at", F.col("position").alias("_pos"))
    both = o.join(new.select("file_path", F.col("content_hash").alias("_new")), "file_path", "full_outer")
    last = old.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("m"))
    seen = both.filter("_pos IS NOT NULL").withColumn("_rn", F.lit(None).cast("long"))
    both = seen.unionByName(in_order(both.filter("_pos IS NULL"), ["file_path"], "_rn")).withColumn("_m", last.scalar())
    position = F.coalesce("_pos", (F.col("_m") + F.col("_rn")).cast("long"))
    return both.select("file_path", F.coalesce("_new", "_old").alias("content_hash"), F.coalesce("added_at", now).alias("added_at"), position.alias("position"))


def statistics(files: DataFrame) -> DataFrame:
    """One row: images, text files and bytes (other documents count 10 000 flat), from paths and sizes alone."""
    ext = suffix(F.col("path"))
    text = ext.isin(*vocab.TEXT_SUFFIXES)
    return files.agg(
        F.count_if(ext.isin(*vocab.IMAGE_SUFFIXES)).alias("images"),
        F.count_if(text | ext.isin(*vocab.BINARY_SUFFIXES)).alias("text_files"),
        F.coalesce(F.sum(F.when(text, F.col("length")).when(ext.isin(*vocab.BINARY_SUFFIXES), 10_000)), F.lit(0)).cast("long").alias("bytes"),
    )


def merged(docs: DataFrame, order: list[str]) -> DataFrame:
    """One text per file_id: documents under their headings, a blank line between; each keeps the offset of its body (origin_char)."""
    head = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("## "), F.col("title"), F.coalesce(F.concat(F.lit(" ("), F.col("date"), F.lit(")")), F.lit("")), F.lit("\n\n"))).otherwise("")
    w = Window.partitionBy("file_id").orderBy(*order)
    rows = docs.withColumn("_head", F.when(F.count("*").over(Window.partitionBy("file_id")) > 1, head).otherwise(""))
    size = F.length("_head") + F.length("content") + 2
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("origin_char", (before + F.length("_head")).cast("long"))
    part = F.struct("origin_char", F.concat("_head", "content").alias("t"))
    return rows.groupBy("file_id").agg(F.sort_array(F.collect_list(part)).alias("p")).select("file_id", F.array_join(F.col("p.t"), "\n\n").alias("content"), F.col("p.origin_char").alias("origins"))
