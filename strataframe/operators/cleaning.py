"""Suggested corrections of cells, their review, and their application to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import scalars, vocab

_SUGGESTION = "suggested string, issue_type string, confidence double, rule int"


def candidates(value: Column, field: Column) -> Column:
    """Array of struct(suggested, issue_type, confidence, rule): every rule that would change the cell, in order. Rules are independent."""
    s = F.trim(value)
    sub = lambda pattern, to, c=s: F.regexp_replace(c, pattern, to)
    if_like = lambda pattern, then, c=s: F.when(c.rlike(pattern), then)
    fy, date = scalars.normalize_financial_year(s), scalars.normalize_date(s)
    unit = sub(r"(?i)\bkm\b", "km", sub(r"(?i)\bkt\b", "KT", sub(r"(?i)\bmt\b", "MT")))
    name = F.lower(field).rlike("|".join(vocab.NAME_FIELDS))
    capital = name & (F.length(s) >= 4) & (F.upper(s) == s) & (F.lower(s) != s) & s.contains(" ")
    spelt, spaced = r"(?i)^([-+]?\d+(?:\.\d+)?)\s*(?:percent|pct)$", r"^([-+]?\d+(?:\.\d+)?)\s+%$"
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    # The rules' patterns, names, confidences and order.
    rules = [
        (F.when(flat != value, flat), "whitespace", 1.0),
        (if_like(r"^[-+]?\d{1,3}(?:,\d{2,3})+(?:\.\d+)?$", sub(",", "")), "comma_number", 0.95),
        (F.coalesce(if_like(r"^\+\d+(?:\.\d+)?$", F.substring(s, F.lit(2), F.length(s))), if_like(r"^\.\d+$", F.concat(F.lit("0"), s))), "numeric_format", 0.95),
        (F.coalesce(if_like(spelt, F.concat(F.regexp_extract(s, spelt, 1), F.lit("%"))), if_like(spaced, F.concat(F.regexp_extract(s, spaced, 1), F.lit("%")))), "percentage", F.when(s.rlike(spelt), 0.9).otherwise(1.0)),
        (F.when(fy != s, fy), "financial_year", 0.95),
        (F.when(date != s, date), "date_format", 0.9),
        (F.when(unit != s, unit), "unit_normalization", 0.85),
        (F.when(capital, scalars.title_case(s)), "capitalization", 0.75),
    ]
    made = F.array(*[F.struct(x.alias("suggested"), F.lit(issue).alias("issue_type"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"), F.lit(k).alias("rule")) for k, (x, issue, c) in enumerate(rules)])
    return F.filter(made, lambda x: x["suggested"].isNotNull())


def suggestions(cells: DataFrame) -> DataFrame:
    """``cells(record_id, field, value)`` to (record_id, field_name, original_value, suggested_value, issue_type, confidence, rule).

    Derived fields (``_original``, ``_unit``, ``_normalized_unit``) and blank cells are left alone.
    """
    rows = cells.where("value is not null and value <> '' and not field rlike '(_original|_unit|_normalized_unit)$'")
    out = rows.select("record_id", F.col("field").alias("field_name"), F.col("value").alias("original_value"), F.explode(candidates(F.col("value"), F.col("field"))).alias("s"))
    return out.select("record_id", "field_name", "original_value", F.col("s.suggested").alias("suggested_value"), "s.issue_type", "s.confidence", "s.rule")


def of_records(records: DataFrame) -> DataFrame:
    """Suggestions over ``records(record_id, data map)``."""
    return suggestions(records.select("record_id", F.explode("data").alias("field", "value")))


def decided(suggestions_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Statuses after ``decisions(suggestion_id, decision)``: pending ones can be approved, pending and approved ones rejected."""
    out = suggestions_.join(decisions, "suggestion_id", "left")
    status = F.when((F.col("decision") == "approve") & (F.col("status") == "pending"), "approved").when((F.col("decision") == "reject") & F.col("status").isin("pending", "approved"), "rejected").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("decision")


def summary(suggestions_: DataFrame) -> DataFrame:
    return suggestions_.groupBy("status").agg(F.count("*").alias("n"))


def apply_approved(cells: DataFrame, suggestions_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, suggestions) after the approved suggestions, in order of their id.

    One applies only to a cell that still holds its original value and otherwise fails, so of two on one cell the first wins. The
    fold is by cell, over that cell's few suggestions; ``before_apply`` keeps the value before the first change.
    """
    order = F.array_sort(F.collect_list(F.when(F.col("status") == "approved", F.struct("suggestion_id", "original_value", "suggested_value"))))
    plans = suggestions_.groupBy("record_id", F.col("field_name").alias("field")).agg(order.alias("plan"))
    start = F.struct(F.col("value").alias("value"), F.array().cast("array<bigint>").alias("done"))

    def step(acc, s):
        return F.when(acc["value"] == s["original_value"], F.struct(s["suggested_value"].alias("value"), F.array_append(acc["done"], s["suggestion_id"]).alias("done"))).otherwise(acc)

    folded = cells.join(plans, ["record_id", "field"], "left").withColumn("f", F.aggregate(F.coalesce("plan", F.array().cast(plans.schema["plan"].dataType)), start, step))
    changed = F.size("f.done") > 0
    after = folded.select("record_id", "field", F.col("f.value").alias("value"), F.when(changed, F.col("value")).alias("before_apply"))
    applied = folded.select(F.explode("f.done").alias("suggestion_id")).withColumn("ok_", F.lit(True))
    marked = suggestions_.join(applied, "suggestion_id", "left")
    return after, marked.withColumn("status", F.when(F.col("status") != "approved", F.col("status")).when(F.col("ok_"), "applied").otherwise("failed")).drop("ok_")
