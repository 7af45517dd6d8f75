"""Sorted pages of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import scalars


def sort_key(name: str, kind: str) -> Column:
    """``numeric`` (unparsable below all), ``year`` or ``text`` key of a column; null for a null cell."""
    c = F.col(name)
    if kind == "numeric":
        return F.when(c.isNotNull(), F.coalesce(scalars.parse_numeric(c.cast("string")), F.lit(float("-inf"))))
    return scalars.financial_year(c) if kind == "year" else F.lower(F.trim(c.cast("string")))


def page(records: DataFrame, sort: str | None = None, kind: str = "text", descending: bool = False, number: int = 1, size: int = 25) -> DataFrame:
    """One page (size 1 to 100), by ``sort`` then row order; nulls come last ascending and first descending."""
    size, number = max(1, min(100, size)), max(1, number)
    keys = []
    if sort:
        k = sort_key(sort, kind)
        keys = [k.desc_nulls_first() if descending else k.asc_nulls_last()]
    return records.orderBy(*keys, "row_index", "record_id").offset((number - 1) * size).limit(size)


def page_count(records: DataFrame, size: int = 25) -> DataFrame:
    size = max(1, min(100, size))
    return records.agg(F.count("*").alias("total"), F.greatest(F.ceil(F.count("*") / F.lit(size)), F.lit(1)).cast("long").alias("pages"))
