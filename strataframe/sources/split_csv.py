"""CSV files of any size, read by many tasks: a file's splits are lines, and records go on over lines and splits where a quoted cell does.

Whether a line begins inside a quoted cell depends on all before it, but a split can only change that in one of two ways: it ends inside or outside, for a begin outside and for one inside. So a first pass
walks each split once for both, the few rows that come of it are put in order for each file, and a second pass cuts every split into records, knowing how it begins. Pieces of the records that lie over
a border of splits, one or two a split, are put together by their record's number.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.sources.readers import ENCODINGS, sniffed

#: Characters of a file by which its delimiter is found (fixed value).
SAMPLE = 4096
#: Records, and characters of lines, after which a task hands on what it has cut.
ROWS, CHARACTERS = 8192, 4_000_000


def ends_inside(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted cell is open at a line's end, by the rules of ``csv.reader``: a quote opens a cell at its begin only, two of them inside are one, and what follows a closing one is taken as it stands."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside, at = False, at + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, split, at, value): lines with their file, the place where their split begins, and a number that rises within it."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))


def file_forms(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, delimiter) of each file: the first of ``ENCODINGS`` that every line has, and the delimiter that its first ``SAMPLE`` characters are sniffed to have."""
    lines = _lines(spark, path)
    encodings = lines.groupBy("path").agg(F.min(F.expr("is_valid_utf8(cast(value as string))")).alias("utf8"))
    # a character has four bytes at most, and a line with its end one character or more
    first = lines.where(F.col("split") < 4 * SAMPLE).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("split", "at"))).where(F.col("n") <= SAMPLE)
    head = first.select("path", "n", F.substring("value", 1, 4 * SAMPLE).alias("value")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoding = [ENCODINGS[0] if u else ENCODINGS[2] for u in b.column(1).to_pylist()]
            found = [sniffed(b"\n".join(h or []).decode(e, "ignore")[:SAMPLE]) for e, h in zip(encoding, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoding, pa.string()), pa.array(found, pa.string())], ["path", "encoding", "delimiter"])

    return encodings.join(head, "path", "left").mapInArrow(run, "path string, encoding string, delimiter string")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str]]:
    """(what is known of its split, line as text) of each line of a partition, split by split; the lines of a split have the same object. A batch is held, not a split."""
    key, known = None, {}
    for b in batches:
        columns = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        for k, (path, split, value) in enumerate(zip(columns["path"], columns["split"], columns["value"], strict=True)):
            if key != (path, split):
                key, known = (path, split), {n: c[k] for n, c in columns.items() if n != "value"}
            yield known, value.decode(known["encoding"] if split == 0 or known["encoding"] != ENCODINGS[0] else "utf-8")


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("path", pa.string()), ("split", pa.int64()), ("from_outside", pa.bool_()), ("starts_outside", pa.int64()), ("from_inside", pa.bool_()), ("starts_inside", pa.int64())])
    out, now = [], None
    for r, line in _walk(batches):
        if r is not now:
            now, row = r, {"path": r["path"], "split": r["split"], "from_outside": False, "starts_outside": 0, "from_inside": True, "starts_inside": 0}
            out.append(row)
        for name in ("outside", "inside"):
            inside = row[f"from_{name}"]
            row[f"starts_{name}"] += not inside
            row[f"from_{name}"] = ends_inside(line, r["delimiter"], inside)
    yield pa.RecordBatch.from_pylist(out, kind)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records: (path, record, whole, split, text, delimiter)."""
    kind = pa.schema([("path", pa.string()), ("record", pa.int64()), ("whole", pa.bool_()), ("split", pa.int64()), ("text", pa.string()), ("delimiter", pa.string())])
    out, now, size = [], None, 0
    done = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
    piece = lambda whole: (now["path"], record, whole, now["split"], "\n".join(held), now["delimiter"])
    for r, line in _walk(batches):
        if r is not now:
            if now is not None:  # the last one may go on in the next split, and the first may have begun before
                out.append(piece(begins and not inside))
            now, inside, record, held = r, r["inside"], r["before"] - 1, []
            begins = not inside
        elif not inside:
            out.append(piece(begins))
            held, begins = [], True
        record += not inside
        held.append(line)
        size += len(line)
        inside = ends_inside(line, r["delimiter"], inside)
        if out and (len(out) >= ROWS or size >= CHARACTERS):
            yield done(out)
            out, size = [], 0
    if now is not None:
        yield done([*out, piece(begins and not inside)])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells = [[c.strip() for row in csv.reader([t.removesuffix("\r")], delimiter=d) for c in row] if t.strip() else [] for t, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.list_(pa.string()))], ["path", "record", "cells"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, row_index, cells) of the CSV files below ``path``: each file's first record is its header, blank records go, ragged ones stay, cells are stripped.

    ``row_index`` counts the records that stay from 0. Encoding and delimiter are found file by file. A record that no quote closes reaches to the file's end, as it does in one piece. Empty files give no rows.
    """
    forms = file_forms(spark, path)
    lines = _lines(spark, path).join(forms, "path").sortWithinPartitions("path", "split", "at")
    # a split lies in one task where it was read, and in one after a shuffle by file and split
    lines = lines.repartition("path", "split").sortWithinPartitions("path", "split", "at")
    moves = lines.drop("at").mapInArrow(_transitions, "path string, split long, from_outside boolean, starts_outside long, from_inside boolean, starts_inside long")
    # a file's splits in order: how each begins, and how many records begin before it
    row = F.struct("split", "from_outside", "starts_outside", "from_inside", "starts_inside")
    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("before"), F.array().cast("array<struct<split:bigint,inside:boolean,before:bigint>>").alias("all"))
    step = lambda s, x: F.struct(
        F.when(s["inside"], x["from_inside"]).otherwise(x["from_outside"]).alias("inside"), (s["before"] + F.when(s["inside"], x["starts_inside"]).otherwise(x["starts_outside"])).alias("before"),
        F.concat(s["all"], F.array(F.struct(x["split"].alias("split"), s["inside"].alias("inside"), s["before"].alias("before")))).alias("all"))
    known = moves.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("l")).select("path", F.inline(F.aggregate("l", begin, step)["all"]))
    cut = lines.join(known, ["path", "split"]).repartition("path", "split").sortWithinPartitions("path", "split", "at").drop("at").mapInArrow(_cut, "path string, record long, whole boolean, split long, text string, delimiter string")
    pieces = cut.where("not whole").groupBy("path", "record", "delimiter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "\n").alias("text"))
    records = cut.where("whole").select("path", "record", "text", "delimiter").unionByName(pieces.select("path", "record", "text", "delimiter")).mapInArrow(_cells, "path string, record long, cells array<string>")
    heads = records.where("record = 0").select("path", F.col("cells").alias("headers"))
    rows = records.where("record > 0").where(F.exists("cells", lambda c: c != ""))
    # places: a file's records in parts of 65,536, with the number that stay before each part
    rows = rows.withColumn("part", F.shiftright("record", 16))
    parts = rows.groupBy("path", "part").agg(F.count("*").alias("n"))
    parts = parts.select("path", "part", (F.sum("n").over(Window.partitionBy("path").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("path", "part").orderBy("record")) - 1
    return rows.withColumn("k", within).join(parts, ["path", "part"]).join(heads, "path").select("path", "headers", (F.col("before") + F.col("k")).alias("row_index"), "cells")
