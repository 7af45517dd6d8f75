"""Two periods side by side: metrics and groups aligned by full outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.aggregates import achievement, exact_sum, rounded_sum


def change_pct(past: Column, current: Column) -> Column:
    """Percent to 2 places; 100 for something out of nothing; null without two values."""
    return F.when(past > 0, F.round((current - past) / past * 100, 2)).when((past == 0) & (current > 0), 100.0).when(past == 0, 0.0)


def status(past: Column, current: Column) -> Column:
    return F.when(past.isNull(), "new").when(current.isNull(), "missing").when(current > past, "improved").when(current < past, "declined").otherwise("unchanged")


def aligned(past: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """``(key, value)`` twice to (key, past, current, difference, pct, status), a row a key of either."""
    p, c = past.select(key, F.col("value").alias("past")), current.select(key, F.col("value").alias("current"))
    out = p.join(c, key, "full_outer")
    return out.withColumn("difference", F.round(F.col("current") - F.col("past"), 2)).withColumn("pct", change_pct(F.col("past"), F.col("current"))).withColumn("status", status(F.col("past"), F.col("current")))


def metrics(records: DataFrame, names: list[str]) -> DataFrame:
    """(metric, value) over valid records."""
    sums = records.where(~F.col("is_error")).agg(*[rounded_sum(F.col(n)).alias(n) for n in names])
    return sums.unpivot([], names, "metric", "value").where("value is not null")


def compare_metrics(past: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    return aligned(metrics(past, names), metrics(current, names), "metric")


def compare_groups(past: DataFrame, current: DataFrame, by: str, metric: str) -> DataFrame:
    value = lambda df: df.where(~F.col("is_error")).where(F.col(by).isNotNull()).groupBy(F.upper(F.trim(by)).alias(by)).agg(rounded_sum(F.col(metric)).alias("value"))
    return aligned(value(past), value(current), by)


def movers(compared: DataFrame) -> DataFrame:
    """``aligned`` rows that improved or declined, each kind by percent from the highest down (without one: 0), as ``place``."""
    order = Window.partitionBy("status").orderBy(F.coalesce("pct", F.lit(0.0)).desc(), compared.columns[0])
    return compared.where(F.col("status").isin("improved", "declined")).withColumn("place", F.row_number().over(order))


def chart(compared: DataFrame, most: int = 6) -> DataFrame:
    """(place, key, past, current): the first rows, by name, that have both values."""
    key = compared.columns[0]
    both = compared.where("past is not null and current is not null").select(key, "past", "current").orderBy(key).limit(most)
    return both.withColumn("place", F.row_number().over(Window.orderBy(key)))  # `most` rows


def new_fields(past: DataFrame, current: DataFrame) -> DataFrame:
    """Fields of ``current(field)`` that ``past(field)`` lacks."""
    return current.select("field").distinct().join(past.select("field"), "field", "left_anti")


def coverage(past: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    """(metric, in_past, in_current): whether either side has a value at all."""
    has = lambda df, flag: df.agg(*[(F.count(n) > 0).alias(n) for n in names]).unpivot([], names, "metric", flag)
    return has(past, "in_past").join(has(current, "in_current"), "metric", "full_outer")


def evacuation(records: DataFrame) -> DataFrame:
    """Dispatch as a percent of production, one row."""
    return records.where(~F.col("is_error")).agg(achievement(exact_sum(F.col("dispatch")), exact_sum(F.col("production"))).alias("evacuation_pct"))


def split_sources(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Past and current: reference rows against the others, or, without reference rows, the earliest year against the rest."""
    flags = records.agg(F.bool_or("is_reference"), F.min("financial_year")).first()
    if flags[0]:
        return records.where("is_reference"), records.where("not is_reference")
    return records.where(F.col("financial_year") == flags[1]), records.where(F.col("financial_year") > flags[1])
