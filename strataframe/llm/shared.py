"""What the operators share: tables, names of working columns, words, and who is held out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.sources.staging import dropped, shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that Python's objects of a batch of long texts don't all live at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Frequent function words of the corpus' languages (fixed values).
COMMON = (
    "the of and to in is that it for on with as was by be at this from are or an a he "
    "le la les de des du et en un une que qui dans pour par sur pas est au avec "
    "der die das und ist von mit zu den dem ein eine nicht auf für als auch sich im "
    "el los las del y por con no se para es su al lo como más"
).split()
#: A word: a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the rows whose labels no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
