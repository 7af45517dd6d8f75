"""Predicates over records. Each gives a Column, so Catalyst pushes it to the scan; sets are semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import scalars

#: Parts of a subsidiary's name: ``ECL`` is one in ``ECL (North)`` and none in ``SECL``.
TOKEN_SPLIT = r"[\s\(\)\/,\.-]+"
_ANY = (None, "", "all", "All")


def contains(c: Column, wanted: str) -> Column:
    """Equal to or containing ``wanted``, whatever the case."""
    return F.lower(F.trim(c)).contains(wanted.strip().lower())


def has_token(c: Column, wanted: str) -> Column:
    """Equal to ``wanted`` or with it as a whole token."""
    low, w = F.lower(F.trim(c)), wanted.strip().lower()
    return (low == w) | F.array_contains(F.split(low, TOKEN_SPLIT), w)


def same_year(c: Column, wanted: str) -> Column:
    """The same financial year in any spelling; where either is none, the same text."""
    year = scalars.financial_year_of(wanted)  # a cell of the same text would hold the same year
    return scalars.is_financial_year(c, *year) if year else F.lower(F.trim(c)) == F.lit(wanted.strip().lower())


def search(columns: list[str], wanted: str) -> Column:
    """``wanted`` anywhere in the row's cells joined by spaces (nulls read ``none``), across cells too."""
    cells = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("none")) for c in columns]
    return F.concat_ws(" ", *cells).contains(wanted.strip().lower())


def predicate(filters: dict[str, str | None], columns: list[str]) -> Column:
    """All filters together. Unknown columns and the values null, empty and ``all`` are no filters; a null cell matches none."""
    found = []
    for name, wanted in filters.items():
        if name not in columns or wanted in _ANY:
            continue
        rule = {"financial_year": same_year, "subsidiary": has_token}.get(name, contains)
        found.append(F.col(name).isNotNull() & rule(F.col(name), str(wanted)))
    return scalars.all_of(found)


def filter_records(records: DataFrame, filters: dict | None = None, query: str | None = None, exclude_errors: bool = True) -> DataFrame:
    """Records that match; those with an error are left out unless asked for (column ``is_error``)."""
    out = records.where(~F.col("is_error")) if exclude_errors else records
    out = out.where(predicate(filters or {}, records.columns))
    return out.where(search([c for c in records.columns if not c.startswith("is_") and not c.endswith("_original")], query)) if query and query.strip() else out


def on_sheet(records: DataFrame, provenance: DataFrame, sheet: str) -> DataFrame:
    """Records with a provenance row of that sheet."""
    return records.join(provenance.where(F.lower(F.trim("sheet_name")) == sheet.strip().lower()).select("record_id"), "record_id", "left_semi")


def without_errors(records: DataFrame, errors: DataFrame) -> DataFrame:
    return records.join(errors.select("record_id"), "record_id", "left_anti")


def by_quality(records: DataFrame, state: str | None) -> DataFrame:
    """``valid_only``, ``with_warnings`` or ``with_errors``; anything else is no filter."""
    rule = {"valid_only": ~F.col("is_error") & ~F.col("is_warning"), "with_warnings": F.col("is_warning"), "with_errors": F.col("is_error")}.get(state or "")
    return records if rule is None else records.where(rule)


def quality_counts(records: DataFrame) -> DataFrame:
    """One row (errors, warnings, clean): how many records each state has, in one pass."""
    return records.agg(F.count_if("is_error").alias("errors"), F.count_if("is_warning").alias("warnings"), F.count_if(~F.col("is_error") & ~F.col("is_warning")).alias("clean"))


def checked_field(name: str, known: list[str]) -> str:
    """``name`` if it is one of the columns; an unknown one raises before anything is planned."""
    if name not in known:
        raise ValueError(f"unknown field: {name}")
    return name


def with_reference(records: DataFrame, owner: str) -> DataFrame:
    """The owner's rows and all owners' reference rows, archived documents left out: what reports are made of."""
    return records.where(((F.col("owner") == owner) | F.col("is_reference")) & ~F.col("is_archived"))


def in_scope(records: DataFrame, owner: str, scope: str | int = "all") -> DataFrame:
    """Rows the owner may see: ``baseline`` (reference rows), ``uploaded``, ``all``, or one dataset; archived documents never."""
    mine = records.where((F.col("owner") == owner) & ~F.col("is_archived"))
    if scope in ("baseline", "reference"):
        return mine.where("is_reference")
    if scope in ("uploaded", "user_uploaded", "user"):
        return mine.where("not is_reference")
    return mine if scope == "all" else mine.where(F.col("dataset_id") == int(scope))
