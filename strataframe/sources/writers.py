"""Sinks: CSV exports, replacement by document, and an append-only log."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.schema import filled, first_seen


def csv_rows(records: DataFrame, columns: list[str]) -> DataFrame:
    """A column for each of ``columns``: the cell, else that of its lower-cased name, else its original."""
    return records.select("row_index", *[filled(F.col("data"), c).alias(c) for c in columns])


def maintained_columns(records: DataFrame) -> list[str]:
    """All keys of the records' data in the order in which they are first seen, without the values kept from before corrections. Keys are a schema, so few."""
    keys = first_seen(records).where("not key like '%\\_original\\_before\\_apply'")
    return [r.key for r in keys.orderBy("place").collect()]


def union_in_order(frames: list[DataFrame]) -> DataFrame:
    """All rows of ``frames``, each with the columns of all in the order in which they are first seen; null where a frame has no such column."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def replace_documents(rows: DataFrame, path: str, by: str = "document_id") -> None:
    """Replace all rows of the documents in ``rows``, leaving other documents' partitions as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def seeded(rows: DataFrame, path: str, clear: bool = False) -> bool:
    """Fill an empty table with ``rows``; whether that was done. One that has rows stays as it is, unless it is to be cleared first."""
    spark = rows.sparkSession
    try:
        filled = not spark.read.schema(rows.schema).parquet(path).isEmpty()
    except AnalysisException:
        filled = False
    if filled and not clear:
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def removed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without those of ``ids(document_id)``; reference rows are protected and stay."""
    return rows.join(ids.select("document_id", F.lit(True).alias("gone_")).distinct(), "document_id", "left").where("gone_ is null or is_reference").drop("gone_")


def archived(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with ``is_archived`` set for those of ``ids(document_id)``, reference rows excepted."""
    marked = rows.join(ids.select("document_id", F.lit(True).alias("gone_")).distinct(), "document_id", "left")
    return marked.withColumn("is_archived", F.col("is_archived") | (F.coalesce("gone_", F.lit(False)) & ~F.col("is_reference"))).drop("gone_")


# Colours of a header's cells and text, and of corrected cells.
HEADER, HEADER_TEXT, CORRECTED = "FF1F4E79", "FFFFFFFF", "FFE2EFDA"
#: Numbers of the cell styles below.
_PLAIN, _HEAD, _MARKED = 0, 1, 2


def _cell(v, style: int = _PLAIN) -> str:
    of = f' s="{style}"' if style else ""
    if v is None:
        return f"<c{of}/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"<c{of}><v>{v}</v></c>"
    # characters that XML can't hold become blanks
    return f'<c{of} t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", " ", str(v)))}</t></is></c>'


def _styles(main: str) -> str:
    fill = lambda c: f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/><bgColor rgb="{c}"/></patternFill></fill>'
    none = "".join(f'<fill><patternFill patternType="{k}"/></fill>' for k in ("none", "gray125"))
    fonts = f'<fonts count="2"><font/><font><b/><color rgb="{HEADER_TEXT}"/></font></fonts>'
    forms = "".join(f'<xf numFmtId="0" fontId="{font}" fillId="{f}" borderId="0" xfId="0" applyFill="1" applyFont="1"/>' for font, f in ((0, 0), (1, 2), (0, 3)))
    return f'<styleSheet xmlns="{main}">{fonts}<fills count="4">{none}{fill(HEADER)}{fill(CORRECTED)}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{forms}</cellXfs></styleSheet>'


def styled_workbook(sheets: list[tuple[str, list[list[tuple]]]]) -> bytes:
    """A workbook of (name, lines) for each sheet, a line being (value, style) for each cell: numbers as numbers, all else as text."""
    out = io.BytesIO()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind, links = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/package/2006/relationships"
    places = range(1, len(sheets) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in places)
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{links}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{links}">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in places) + f'<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, (name, _) in zip(places, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/styles.xml", _styles(main))
        for i, (_, lines) in zip(places, sheets, strict=True):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(_cell(*c) for c in line) + "</row>" for line in lines) + "</sheetData></worksheet>")
    return out.getvalue()


def workbook(lines: list, sheet: str) -> bytes:
    """A workbook of one sheet."""
    return styled_workbook([(sheet, [[(v, _PLAIN) for v in line] for line in lines])])


def maintained_workbooks(records: DataFrame, applied: DataFrame, datasets: DataFrame, exported_at: str, most: int = 100_000) -> DataFrame:
    """``records(dataset_id, record_id, row_index, data map)`` of maintained datasets as files: (path, extension, n, content), a workbook for each ``most`` row numbers of a dataset.

    The sheet ``Maintained Data`` has a styled header of all the dataset's keys, in the order in which they are first seen (without those that keep values from before corrections), and marks the cells whose
    ``applied(record_id, field_name)`` corrections were applied. ``Maintainer Info`` names the dataset, its source (``datasets(dataset_id, name, source)``), its number of records, when it was exported and what the file is. Tasks get ranges of rows; no dataset passes one task or the driver.
    """
    keys = first_seen(records, by=("dataset_id",)).where("not key like '%\\_original\\_before\\_apply'")
    heads = keys.groupBy("dataset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("heads"))  # a schema
    about = datasets.select("dataset_id", "name", "source").join(records.groupBy("dataset_id").agg(F.count("*").alias("many")), "dataset_id").join(heads, "dataset_id")
    marks = applied.groupBy("record_id").agg(F.collect_set("field_name").alias("marks"))
    rows = records.select("dataset_id", "record_id", "row_index", "data", F.floor(F.col("row_index") / most).alias("part")).join(marks, "record_id", "left").join(about, "dataset_id")
    rows = rows.select("dataset_id", "part", "row_index", "record_id", "name", "source", "many", "heads", F.transform("heads", lambda h: F.coalesce(F.try_element_at("data", h), F.lit(""))).alias("cells"), F.transform("heads", lambda h: F.coalesce(F.array_contains("marks", h), F.lit(False))).alias("marked"))

    def book(r: dict, lines: list) -> dict:
        info = [("Dataset", r["name"] or ""), ("Source Document", r["source"] or ""), ("Records", r["many"]), ("Exported At", exported_at), ("Note", "This is a DERIVED file. Original source is immutable.")]
        sheets = [("Maintained Data", [[(h, _HEAD) for h in r["heads"]], *lines]), ("Maintainer Info", [[(v, _PLAIN) for v in line] for line in info])]
        return {"path": f"{r['dataset_id']}-{r['part']:06d}-maintained.xlsx", "extension": "xlsx", "n": len(lines), "content": styled_workbook(sheets)}

    def run(batches):
        now, lines = None, []
        for b in batches:
            for r in b.to_pylist():
                if now is not None and (r["dataset_id"], r["part"]) != (now["dataset_id"], now["part"]):
                    yield pa.RecordBatch.from_pylist([book(now, lines)], _BOOKS)
                    lines = []
                now = r
                lines.append([(v, _MARKED if m else _PLAIN) for v, m in zip(r["cells"], r["marked"], strict=True)])
        if now is not None:
            yield pa.RecordBatch.from_pylist([book(now, lines)], _BOOKS)

    return rows.repartition("dataset_id", "part").sortWithinPartitions("dataset_id", "part", "row_index", "record_id").mapInArrow(run, "path string, extension string, n long, content binary")


def workbooks(rows: DataFrame, order: list[str], sheet: str = "Data", most: int = 100_000) -> DataFrame:
    """``rows`` in order as files: (path, extension, n, content), a workbook for each ``most`` rows of a range of the order, named by place.

    Rows are dealt to tasks by range and no row passes the driver; every row is in one workbook, each of which begins with the column names.
    """
    names = rows.columns

    def run(batches):
        from pyspark import TaskContext

        part, number, hold = TaskContext.get().partitionId(), 0, []

        def book():
            return pa.RecordBatch.from_pylist([{"path": f"{sheet}-{part:06d}-{number:06d}.xlsx", "extension": "xlsx", "n": len(hold), "content": workbook([names, *hold], sheet)}], _BOOKS)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hold.append(row)
                if len(hold) == most:
                    yield book()
                    number, hold = number + 1, []
        if hold:
            yield book()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "path string, extension string, n long, content binary")


_BOOKS = pa.schema([("path", pa.string()), ("extension", pa.string()), ("n", pa.int64()), ("content", pa.binary())])


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A report's tables as JSON lines, a folder a table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
