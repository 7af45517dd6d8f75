"""Findings of validation rules, and the quality of records by them. Rules report; they never drop a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import scalars, vocab
from strataframe.operators.schema import columns_of

_TYPE = "struct<row_index:int,issue_type:string,severity:string,field_name:string,original_value:string>"


def _issue(issue: str, severity: str, row: Column | None = None, field: Column | None = None, value: Column | None = None) -> Column:
    null = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return F.struct(null(row, "int").alias("row_index"), F.lit(issue).alias("issue_type"), F.lit(severity).alias("severity"), null(field, "string").alias("field_name"), null(value, "string").alias("original_value"))


def cell_issues(row: Column, header: Column, concept: Column, value: Column) -> Column:
    """The findings of a cell under its column's concept: no number, negative, no coordinate, out of range; null where there is none."""
    number, at = scalars.numeric_and_unit(value)["value"], scalars.coordinate(value)
    bound = F.when(concept == "longitude", 180.0).otherwise(90.0)
    issue = lambda name, severity: _issue(name, severity, row, header, value)
    return (
        F.when(F.coalesce(F.trim(value), F.lit("")) == "", None)
        .when(concept.isin(*vocab.CHECKED), scalars.let(number, lambda n: F.when(n.isNull(), issue("invalid_numeric", "ERROR")).when(concept.isin(*vocab.NON_NEGATIVE) & (n < 0), issue("suspicious_value", "WARNING"))))
        .when(concept.isin("latitude", "longitude", "coordinates"), F.when(at.isNull(), issue("coordinate_error", "WARNING")).when(F.abs(at) > bound, issue("coordinate_error", "ERROR")))
    )


def validate(tables: DataFrame, document_fields: list[str] | None = None) -> DataFrame:
    """Findings over ``tables(source_ref, headers array, rows array<array>)``: (source_ref, row_index, issue_type, severity, field_name, original_value).

    Empty tables; repeated headers; important fields that neither a table nor the document has; rows with more cells than headers;
    repeated rows; and, by concept of the column, cells that are no number, negative, no coordinate or out of range.

    One pass over the tables gives all of them and finds each column's concept once. A table's rows are compared in their own row, each with the one before it in their order: nothing is shuffled.
    """
    has = lambda x: x.isNotNull()
    columns = columns_of(F.col("headers"))
    full = tables.select("source_ref", "headers", "rows", columns.alias("columns"))
    empty = F.when((F.size("headers") == 0) & (F.size("rows") == 0), F.array(_issue("extraction_failure", "WARNING")))
    repeated = F.filter(F.transform("headers", lambda h, i: F.when(F.array_position("headers", h) <= i, _issue("duplicate", "WARNING", None, h, h))), has)
    wanted = [f for f in vocab.IMPORTANT_FIELDS if f not in (document_fields or [])]
    missing = F.transform(F.array_except(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"), F.transform("columns", lambda c: c["concept"])), lambda f: _issue("missing_required", "INFO", None, f))
    long = F.filter(F.transform("rows", lambda r, i: F.when((F.size(r) > F.size("headers")) & (F.size("headers") > 0), _issue("schema_mismatch", "WARNING", i))), has)
    cells = F.filter(F.flatten(F.transform("rows", lambda r, i: F.transform("columns", lambda c, k: cell_issues(i, c["header"], c["concept"], F.get(r, k))))), has)
    ordered = F.sort_array(F.transform("rows", lambda r, i: F.struct(r.alias("cells"), i.alias("i"))))
    again = F.filter(scalars.let(ordered, lambda s: F.transform(s, lambda x, k: F.when((k > 0) & x["cells"].eqNullSafe(F.get(s, k - 1)["cells"]), _issue("duplicate_record", "WARNING", x["i"])))), has)
    return full.select("source_ref", F.inline(F.coalesce(empty, F.concat(repeated, missing, long, cells, again)).cast(f"array<{_TYPE}>")))


def duplicate_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., repeats): how often each row that occurs more than once occurs again."""
    return rows.groupBy(*key).agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def flagged(records: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds ``is_error`` and ``is_warning`` from the rows' own validity and open findings (``record_id, severity, status``); both may hold."""
    open_ = findings.where("status = 'open'").groupBy("record_id").agg(F.bool_or(F.col("severity") == "ERROR").alias("e_"), F.bool_or(F.col("severity") == "WARNING").alias("w_"))
    own_e = F.exists("validation_errors", lambda x: x["severity"] == "ERROR")
    own_w = F.exists("validation_errors", lambda x: x["severity"] == "WARNING")
    out = records.join(open_, "record_id", "left")
    error = ~F.col("is_valid") | F.coalesce(own_e, F.lit(False)) | F.coalesce("e_", F.lit(False))
    warning = (F.coalesce(own_w, F.lit(False)) & ~F.coalesce(own_e, F.lit(False))) | F.coalesce("w_", F.lit(False))
    return out.withColumn("is_error", error).withColumn("is_warning", warning).drop("e_", "w_")


def document_status(findings: DataFrame) -> DataFrame:
    """(source_ref, status): needs_review with any error, else indexed."""
    return findings.groupBy("source_ref").agg(F.when(F.bool_or(F.col("severity") == "ERROR"), "needs_review").otherwise("indexed").alias("status"))


def counters(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
