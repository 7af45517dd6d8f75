"""Files to extracted tables and texts. Office files are parsed from their XML inside tasks, one file at a time."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import scalars

TABLES = "path string, source_ref string, sheet_name string, section_heading string, headers array<string>, rows array<array<string>>"
EXTENSIONS = ("csv", "txt", "xlsx", "docx")
#: Encodings in the order in which they are tried; the third takes any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "latin-1", "cp1252")


def decoded(data: bytes) -> str:
    for e in ENCODINGS:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def files(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """(path, extension, length, content, signature_ok, sha256) of the files below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", f"*.{extension}") if extension else reader
    e = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return reader.load(path).select("path", e.alias("extension"), "length", "content", scalars.signature_ok(e, F.col("content")).alias("signature_ok"), F.sha2("content", 256).alias("sha256"))


def inside(root: str, name: str) -> str:
    """The path of ``name`` below ``root``; one that leads out of it, or is absolute, raises."""
    place = posixpath.normpath(name.replace("\\", "/"))
    if not name or place in (".", "..") or place.startswith(("/", "../")) or ":" in place.split("/")[0]:
        raise ValueError(f"not below {root}: {name}")
    return f"{root.rstrip('/')}/{place}"


def admitted(found: DataFrame, most: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """(files to read, rejects with a reason): by extension, size and signature."""
    reason = F.when(~F.col("extension").isin(*EXTENSIONS, "pdf", "png", "jpg", "jpeg"), "extension").when(F.col("length") > most, "size").when(F.col("length") == 0, "empty").when(~F.col("signature_ok"), "signature")
    judged = found.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("path", "extension", "length", "reason")


def sniffed(sample: str) -> str:
    """The delimiter of a sample among comma, semicolon, tab and bar; where the sample as a whole shows none, as with ragged rows, the most frequent of its first line, else a comma."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        line = next((x for x in sample.splitlines() if x.strip()), "")
        return max(",;\t|", key=line.count)


def csv_table(data: bytes) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a whole file, the delimiter sniffed from its first 4,096 characters; blank rows go, ragged ones stay."""
    text = decoded(data)
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=sniffed(text[:4096]))]
    return (rows[0], [r for r in rows[1:] if any(r)]) if rows else ([], [])


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xlsx_tables(data: bytes) -> list[tuple[str, list[str], list[list[str]]]]:
    """(sheet, header, rows) of each sheet: the first non-empty row is the header, empty rows go, formulas give their stored values."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if (root := _xml(z, "xl/sharedStrings.xml")) is not None:
            shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in root]
        book, links = _xml(z, "xl/workbook.xml"), _xml(z, "xl/_rels/workbook.xml.rels")
        target = {r.get("Id"): r.get("Target") for r in links} if links is not None else {}
        for sheet in (s for s in book.iter() if _local(s.tag) == "sheet"):
            place = target.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), ""), "")
            root = _xml(z, place.lstrip("/") if place.startswith("/") else f"xl/{place}")
            rows = []
            for row in (r for r in root.iter() if _local(r.tag) == "row") if root is not None else ():
                cells: dict[int, str] = {}
                for c in row:
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                    cells[column] = (shared[int(value)] if c.get("t") == "s" and value else value).strip()
                if any(cells.values()):
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            out.append((sheet.get("name", ""), rows[0] if rows else [], rows[1:]))
    return out


# Names of the styles that make a paragraph a heading.
HEADING_STYLES = ("heading 1", "heading 2", "heading 3", "heading 4", "title", "subtitle")


def docx_content(data: bytes) -> tuple[str, list[tuple[str, list[str], list[list[str]]]]]:
    """Paragraphs joined by newlines, and (heading, header, rows) of each table, the heading being the last one above it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root, styles = _xml(z, "word/document.xml"), _xml(z, "word/styles.xml")
    value = lambda e: next((v for k, v in e.attrib.items() if _local(k) == "val"), "")
    name = {}
    for style in (s for s in styles if _local(s.tag) == "style") if styles is not None else ():
        name |= {next((v for k, v in style.attrib.items() if _local(k) == "styleId"), ""): value(e) for e in style if _local(e.tag) == "name"}
    text = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    heading, paragraphs, tables = "", [], []

    def walk(parent):
        nonlocal heading
        for e in parent:
            if _local(e.tag) == "p":
                paragraphs.append(said := text(e).strip())
                style = next((value(s) for s in e.iter() if _local(s.tag) == "pStyle"), "")
                # a style without a definition goes by its id, which has no blanks
                if said and (name.get(style, "").lower() in HEADING_STYLES or (style not in name and style.lower() in [h.replace(" ", "") for h in HEADING_STYLES])):
                    heading = said
            elif _local(e.tag) == "tbl":
                rows = [[text(c).strip() for c in r if _local(c.tag) == "tc"] for r in e.iter() if _local(r.tag) == "tr"]
                tables.append((heading, rows[0] if rows else [], rows[1:]))
            else:
                walk(e)

    walk(root)
    return "\n".join(p for p in paragraphs if p), tables


def _tables_of(path: str, extension: str, data: bytes) -> Iterator[tuple]:
    name = path.rpartition("/")[2]
    if extension == "csv":
        yield path, name, None, None, *csv_table(data)
    elif extension == "xlsx":
        for sheet, headers, rows in xlsx_tables(data):
            yield path, f"{name}#{sheet}", sheet, None, headers, rows
    elif extension == "docx":
        for k, (heading, headers, rows) in enumerate(docx_content(data)[1]):
            yield path, f"{name}#table{k + 1}", None, heading, headers, rows


def tables(found: DataFrame) -> DataFrame:
    """``TABLES`` rows of the files' tables. A file that can't be parsed gives one empty table, which validation reports."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, extension, data in zip(f["path"], f["extension"], f["content"], strict=True):
                try:
                    out += _tables_of(path, extension, bytes(data))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, csv.Error, ValueError, AttributeError):
                    out.append((path, path.rpartition("/")[2], None, None, [], []))
            yield pd.DataFrame(out, columns=["path", "source_ref", "sheet_name", "section_heading", "headers", "rows"])

    return found.where(F.col("extension").isin("csv", "xlsx", "docx")).select("path", "extension", "content").mapInPandas(run, TABLES)


def texts(found: DataFrame, most: int | None = None) -> DataFrame:
    """(path, raw_text) of text and Word files, whole, or ``most`` characters of each where a limit is wanted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, extension, data in zip(f["path"], f["extension"], f["content"], strict=True):
                try:
                    rows.append((path, (docx_content(bytes(data))[0] if extension == "docx" else decoded(bytes(data)))[:most]))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    rows.append((path, ""))
            yield pd.DataFrame(rows, columns=["path", "raw_text"])

    return found.where(F.col("extension").isin("txt", "docx")).select("path", "extension", "content").mapInPandas(run, "path string, raw_text string")


def seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects as a table."""
    return spark.read.schema(schema).json(path, multiLine=True)
