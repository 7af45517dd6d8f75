"""Tables that grow by committed batches: a batch is written once, whole or not at all, and never rewritten.

A batch's files lie in a folder of its own, and a one-row marker, written last, commits it. Readers take committed batches alone, so what a run that died has left
is not seen, and the same batch written again replaces it. A second append of a committed batch adds nothing; with other rows it raises.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "batch string, part string, n long, digest string"


class Rewritten(ValueError):
    """A committed batch was given again with other rows."""


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, part, n, digest) of the committed batches below ``path``; none where nothing was appended yet."""
    try:
        return spark.read.schema(_COMMITS).option("recursiveFileLookup", "true").json(f"{path}/commits")
    except AnalysisException:
        return spark.createDataFrame([], _COMMITS)


def contents(rows: DataFrame) -> tuple[int, str]:
    """Number of rows, and a digest that does not depend on their order: 128 bits a row, added up in four parts."""
    row = F.md5(F.to_json(F.struct(*[F.struct(F.col(f"`{c}`").alias("v")).alias(f"c{i}") for i, c in enumerate(rows.columns)])).cast("binary"))
    sums = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("long").cast("decimal(38,0)")) for i in range(4)]
    n, *found = rows.agg(F.count("*"), *sums).first()
    return n, ",".join(str(x or 0) for x in found)


def append_once(spark: SparkSession, path: str, batch: str, parts: dict[str, DataFrame]) -> bool:
    """Append each of ``parts`` (name to rows) as ``batch``; whether anything was written.

    The rows should be a scan or a stored table: they are read for their digest and again to be written. Appending the same batch again is no change, and of
    two writers of one batch the second marker raises.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or not all(re.fullmatch(r"[A-Za-z0-9_]+", p) and p != "commits" for p in parts):
        raise ValueError("names of batches and parts are letters, digits and _.-")
    found = {name: contents(rows) for name, rows in parts.items()}
    before = {r.part: (r.n, r.digest) for r in commits(spark, path).where(F.col("batch") == batch).collect()}  # a row a part
    if before:
        if before != found:
            raise Rewritten(f"batch {batch} is committed with other rows")
        return False
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    marker = spark.createDataFrame([(batch, name, n, digest) for name, (n, digest) in found.items()], _COMMITS)
    marker.coalesce(1).write.mode("errorifexists").json(f"{path}/commits/{batch}")
    return True


def committed(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """The rows of ``part`` in committed batches, with their ``batch``. Nothing appended yet: no rows."""
    try:
        rows = spark.read.schema(f"{schema}, batch string").option("basePath", f"{path}/{part}").parquet(f"{path}/{part}")
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch string")
    return rows.join(commits(spark, path).select("batch").distinct(), "batch", "left_semi")
