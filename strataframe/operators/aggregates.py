"""Aggregates over records: global and grouped values, indicators, breakdowns, options.

Sums of doubles go through decimals, so the order in which partitions arrive never shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import scalars

FUNCTIONS = ("sum", "avg", "min", "max", "count")


#: Sums are of decimals of this type: exact from 1e-8 up to 1e20; a larger value raises.
EXACT = "decimal(28,8)"


def exact_sum(c: Column) -> Column:
    return F.sum(c.cast(EXACT)).cast("double")


def rounded_sum(c: Column, digits: int = 2) -> Column:
    """A sum rounded as a decimal, half up, before it becomes a double: a tie stays one."""
    return F.round(F.sum(c.cast(EXACT)), digits).cast("double")


def measure(function: str, metric: str) -> Column:
    """One aggregate of a metric, to 2 places. ``count`` counts rows whatever the metric."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown aggregate: {function}")
    c = F.col(metric)
    if function == "count":
        return F.count("*").cast("double")
    if function == "sum":
        return rounded_sum(c)
    if function == "avg":
        return F.round(exact_sum(c) / F.count(c), 2)
    return F.round((F.min if function == "min" else F.max)(c), 2)


def total(records: DataFrame, function: str, metric: str) -> DataFrame:
    """(value, record_count); 0 over nothing."""
    n = F.count("*").alias("record_count") if function == "count" else F.count(metric).alias("record_count")
    return records.agg(F.coalesce(measure(function, metric), F.lit(0.0)).alias("value"), n)


def first_ids(records: DataFrame, by: str, n: int = 50) -> DataFrame:
    """(by, ids): each group's first ``n`` record ids by row order, as text. Rows are ranked, and no more than ``n`` of a group collected."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("row_index", "record_id"))
    first = records.select(by, "row_index", "record_id").withColumn("rank_", rank).where(F.col("rank_") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("rank_", "record_id")))
    return first.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["record_id"].cast("string")), ",").alias("ids"))


def grouped(records: DataFrame, by: str, function: str, metric: str, sort_by: str = "value", descending: bool = True, limit: int = 50) -> DataFrame:
    """(grp, value, record_count, total_groups): groups by trimmed value, those without a number left out, sorted and cut.

    Ties keep the order of the group's name; financial years sort by year.
    """
    rows = records.withColumn("grp", F.trim(F.col(by).cast("string"))).where("grp is not null and grp <> ''")
    out = rows.groupBy("grp").agg(measure(function, metric).alias("value"), F.count("*").alias("record_count"), F.count(metric).alias("n_"))
    out = (out if function == "count" else out.where("n_ > 0")).drop("n_")
    out = out.withColumn("total_groups", out.agg(F.count("*")).scalar())
    key = F.col("value") if sort_by == "value" else (F.coalesce(scalars.financial_year(F.col("grp")), F.struct(F.lit(9999).alias("start"), F.lit(9999).alias("end"))) if by == "financial_year" else F.lower("grp"))
    return out.orderBy(key.desc() if descending else key.asc(), "grp").limit(max(1, min(200, limit)))


def achievement(production: Column, target: Column, digits: int = 1) -> Column:
    return F.when(target > 0, F.round(production / target * 100, digits))


def indicators(records: DataFrame) -> DataFrame:
    """One row: totals over valid rows, achievement, distinct counts, and quality counts over all rows."""
    ok = ~F.col("is_error")
    sums = {f"total_{m}": rounded_sum(F.when(ok, F.col(m))) for m in ("production", "target", "dispatch")}
    out = records.agg(
        *[c.alias(k) for k, c in sums.items()],
        F.countDistinct(F.when(ok, F.col("mine"))).alias("mine_count"), F.countDistinct(F.when(ok, F.col("subsidiary"))).alias("subsidiary_count"),
        F.count_if(ok).alias("record_count"), F.count_if("is_error").alias("error_count"), F.count_if("is_warning").alias("warning_count"))
    return out.withColumn("achievement_pct", achievement(F.col("total_production"), F.col("total_target")))


def latest_growth(records: DataFrame) -> DataFrame:
    """One row: growth between the last two financial years of production, else dispatch, else target, whichever first has two."""
    names = ["production", "dispatch", "target"]
    # years are parsed after the cells' spellings have been grouped; those without one make a null year, which ranks last
    spelt = records.where(~F.col("is_error")).groupBy("financial_year").agg(*[F.sum(F.col(m).cast(EXACT)).alias(m) for m in names])
    each = spelt.groupBy(scalars.format_financial_year(scalars.financial_year(F.col("financial_year"))).alias("fy")).agg(*[F.sum(m).cast("double").alias(m) for m in names])
    tall = each.unpivot("fy", names, "metric", "value").where("value is not null")
    ranked = tall.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("fy")))).where("r <= 2")
    two = ranked.groupBy("metric").agg(F.max(F.when(F.col("r") == 1, F.col("fy"))).alias("current_fy"), F.max(F.when(F.col("r") == 1, F.col("value"))).alias("current"), F.max(F.when(F.col("r") == 2, F.col("fy"))).alias("previous_fy"), F.max(F.when(F.col("r") == 2, F.col("value"))).alias("previous"))
    two = two.where("previous_fy is not null and previous > 0").withColumn("rank", F.expr("case metric when 'production' then 1 when 'dispatch' then 2 else 3 end"))
    return two.orderBy("rank").limit(1).select("metric", "previous_fy", "current_fy", "previous", "current", F.round((F.col("current") - F.col("previous")) / F.col("previous") * 100, 4).alias("growth_pct"))


def breakdown(records: DataFrame, by: str, metric: str = "production", limit: int = 20) -> DataFrame:
    """(grp, value, record_count, share_pct): the largest groups; shares are of what is shown."""
    value = F.count("*").cast("double") if metric == "count" else rounded_sum(F.col(metric))
    rows = records.where(~F.col("is_error")).withColumn("grp", F.trim(F.col(by).cast("string"))).where("grp is not null and grp <> ''")
    top = rows.groupBy("grp").agg(value.alias("value"), F.count("*").alias("record_count")).where("value is not null").orderBy(F.desc("value"), "grp").limit(max(1, min(100, limit)))
    every = F.sum(F.col("value").cast(EXACT)).over(Window.partitionBy()).cast("double")
    return top.withColumn("share_pct", F.when(every > 0, F.round(F.col("value") / every * 100, 1)).otherwise(0.0))


def options(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value): distinct trimmed values of each field."""
    tall = records.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields])).alias("o")).select("o.*")
    return tall.where("value is not null and value <> ''").distinct()


def label_value(label: Column, value: Column, metric: str) -> Column:
    """Value of a key-value row whose label contains the metric's name."""
    return F.when(F.lower(label).contains(metric), scalars.parse_numeric(value))


def best_record(records: DataFrame, metric: str, function: str) -> DataFrame:
    """The winning record of ``max`` or ``min`` (first in row order on ties), or one row with the ``sum`` or ``avg``."""
    if function in ("max", "min"):
        key = F.desc(metric) if function == "max" else F.asc(metric)
        return records.where(F.col(metric).isNotNull()).orderBy(key, "row_index", "record_id").limit(1)
    return total(records, function, metric)
