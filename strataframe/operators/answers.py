"""Answers to batches of structured questions, from one table of group values. No question is looped over on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import scalars
from strataframe.operators.aggregates import EXACT
from strataframe.operators.compare import change_pct

METRICS = ("production", "target", "dispatch")
#: Sets of what a question may name; null in a group's row stands for all.
_NAMED = [["mine", "year"], ["mine"], ["subsidiary", "year"], ["subsidiary"], ["year"], []]


def _clean(c: str) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def group_values(records: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(mine, subsidiary, year, metric, total, n, lowest, highest, first, first_document): a row a group of each set in ``_NAMED``.

    Records are aggregated once, by mine, subsidiary and the year's spelling; the sets are rolled up from those few rows. ``lowest``, ``highest`` and
    ``first`` (in row order) are structs with the record's value and mine; ``first_document`` is of records without mine and subsidiary. Records with errors
    take part, as questions ask what documents say.
    """
    tall = records.select(_clean("mine").alias("mine"), _clean("subsidiary").alias("subsidiary"), "financial_year", F.col("mine").alias("name"), "row_index", "record_id", *metrics)
    tall = tall.unpivot(["mine", "subsidiary", "financial_year", "name", "row_index", "record_id"], list(metrics), "metric", "v").where("v is not null")
    low = F.struct("v", "row_index", "record_id", "name")
    high = F.struct("v", (-F.col("row_index")).alias("row_index"), (-F.col("record_id")).alias("record_id"), "name")
    first = F.struct("row_index", "record_id", "v", "name")
    base = tall.groupBy("mine", "subsidiary", "financial_year", "metric").agg(F.sum(F.col("v").cast(EXACT)).alias("total"), F.count("*").alias("n"), F.min(low).alias("lowest"), F.max(high).alias("highest"), F.min(first).alias("first"))
    base = base.withColumn("first_document", F.when(F.col("mine").isNull() & F.col("subsidiary").isNull(), F.col("first")))
    base = base.withColumn("year", scalars.format_financial_year(scalars.financial_year(F.col("financial_year"))))
    keys = [F.col(c) for c in ("mine", "subsidiary", "year", "metric")]
    out = base.groupingSets([[F.col(c) for c in (*s, "metric")] for s in _NAMED], *keys).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.min("first").alias("first"), F.min("first_document").alias("first_document"),
        *[F.grouping(c).alias(f"all_{c}") for c in ("mine", "subsidiary", "year")])
    # a null that a set groups by is no name
    for c in ("mine", "subsidiary", "year"):
        out = out.where((F.col(f"all_{c}") == 1) | F.col(c).isNotNull()).drop(f"all_{c}")
    return out


def answered(questions: DataFrame, records: DataFrame) -> DataFrame:
    """``questions(question_id, [mine], subsidiary, year, metric, aggregation)`` with ``value``, ``name``, ``n``, ``calculation`` and ``answer``.

    A question that names a mine, or else a subsidiary, gets that one's first record with a value, in row order, whatever its aggregation. Any other
    one gets the first record of a whole document (neither mine nor subsidiary), without one the sum, average, highest or lowest of all; a null
    aggregation is a sum. A null year is any. Without records the value is null and the answer says so.
    """
    q = questions if "mine" in questions.columns else questions.withColumn("mine", F.lit(None).cast("string"))
    named_mine, named_sub = F.upper(F.trim("mine")), F.when(F.col("mine").isNull(), F.upper(F.trim("subsidiary")))
    q = q.withColumns({"mine_": named_mine, "sub_": named_sub})
    g = group_values(records).withColumnsRenamed({"mine": "m_", "subsidiary": "s_", "year": "y_", "metric": "k_"})
    out = q.join(g, F.expr("mine_ <=> m_ and sub_ <=> s_ and year <=> y_ and metric = k_"), "left")
    specific = F.col("mine_").isNotNull() | F.col("sub_").isNotNull()
    how = F.when(specific, F.lit("lookup")).when(F.col("first_document").isNotNull(), "document").otherwise(F.coalesce("aggregation", F.lit("sum")))
    out = out.withColumn("calculation", how)
    of = lambda kind, c: F.when(F.col("calculation") == kind, c)
    value = F.coalesce(of("lookup", F.col("first.v")), of("document", F.col("first_document.v")), of("max", F.col("highest.v")), of("min", F.col("lowest.v")), of("avg", F.round(F.col("total").cast("double") / F.col("n"), 2)), of("sum", F.round("total", 2).cast("double")))
    name = F.coalesce(of("lookup", F.col("first.name")), of("document", F.col("first_document.name")), of("max", F.col("highest.name")), of("min", F.col("lowest.name")))
    title = F.coalesce(of("max", F.lit("Highest")), of("min", F.lit("Lowest")), of("avg", F.lit("Average")), of("sum", F.lit("Total")))
    what = F.concat_ws(" ", title, "metric", F.concat(F.lit("of "), F.coalesce("mine_", "sub_")), F.concat(F.lit("in "), F.col("year")))
    text = F.when(value.isNull(), F.concat(what, F.lit(": no data"))).otherwise(F.concat(what, F.lit(": "), F.format_number(value, 2), F.coalesce(F.concat(F.lit(" ("), name, F.lit(")")), F.lit(""))))
    return out.select(*[c for c in questions.columns], value.alias("value"), name.alias("name"), F.coalesce("n", F.lit(0)).alias("n"), "calculation", text.alias("answer"))


def compared(questions: DataFrame, past: DataFrame, current: DataFrame) -> DataFrame:
    """``questions(question_id, subsidiary, metric)`` with the past and current totals, their difference and percent. A null subsidiary is all."""

    def totals(records: DataFrame, name: str) -> DataFrame:
        tall = records.select(_clean("subsidiary").alias("s_"), *METRICS).unpivot("s_", list(METRICS), "m_", "v").where("v is not null")
        sums = tall.groupBy("s_", "m_").agg(F.sum(F.col("v").cast(EXACT)).alias("v"))
        every = sums.groupBy("m_").agg(F.sum("v").alias("v")).withColumn("s_", F.lit(None).cast("string"))
        return sums.where("s_ is not null").unionByName(every).select("s_", "m_", F.round("v", 2).cast("double").alias(name))

    out = questions
    for side in (totals(past, "past"), totals(current, "current")):
        out = out.join(side, F.expr("upper(trim(subsidiary)) <=> s_ and metric = m_"), "left").drop("s_", "m_")
    return out.withColumn("difference", F.round(F.col("current") - F.col("past"), 2)).withColumn("pct", change_pct(F.col("past"), F.col("current")))


def fields_in_text(chunks: DataFrame, patterns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, field, value): for each field the first match of its pattern (one group) in a document's chunks, in chunk order."""
    found = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.regexp_extract("content", p, 1)), F.lit("")).alias("value")) for f, p in patterns.items()])
    rows = chunks.select(key, "chunk_index", F.inline(found)).where("value is not null")
    return rows.groupBy(key, "field").agg(F.min_by("value", "chunk_index").alias("value"))


def resolved_fields(structured: DataFrame, textual: DataFrame, text_first: list[str], key: str = "doc_id") -> DataFrame:
    """``(key, field, value)`` from tables and from texts to (key, field, value, origin): the preferred source's value where it has one, else the other's.

    Fields of ``text_first`` prefer the text, all others the table.
    """
    sides = structured.select(key, "field", F.col("value").alias("s_")).join(textual.select(key, "field", F.col("value").alias("t_")), [key, "field"], "full_outer")
    by_text = F.col("field").isin(*text_first)
    from_text = F.when(by_text, F.col("t_").isNotNull()).otherwise(F.col("s_").isNull())
    return sides.select(key, "field", F.when(from_text, F.col("t_")).otherwise(F.col("s_")).alias("value"), F.when(from_text, "text").otherwise("table").alias("origin")).where("value is not null")


def reference_answers(questions: DataFrame, records: DataFrame) -> DataFrame:
    """``answered`` over the reference rows of all owners (column ``is_reference``): what an organization's history says."""
    return answered(questions, records.where("is_reference"))


def citations(found: DataFrame, key: str = "question_id") -> DataFrame:
    """``found(key, rank, source_ref, ...)`` with one row for each source of a question, the best ranked, and ``n_sources``."""
    best = Window.partitionBy(key, "source_ref").orderBy("rank")
    one = found.withColumn("r_", F.row_number().over(best)).where("r_ = 1").drop("r_")
    return one.withColumn("n_sources", F.count("*").over(Window.partitionBy(key)))


def first_candidates(records: DataFrame, subsidiary: str, metric: str) -> DataFrame:
    """The first record, in row order, of a subsidiary with a value of the metric."""
    rows = records.where((F.upper(F.trim("subsidiary")) == subsidiary.upper()) & F.col(metric).isNotNull())
    first = F.row_number().over(Window.partitionBy("subsidiary").orderBy("row_index", "record_id"))
    return rows.withColumn("n_", first).where("n_ = 1").drop("n_")


