"""Values by period with growth from one period to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import scalars
from strataframe.operators.aggregates import EXACT, achievement


def growth(value: Column, order: Window, digits: int = 1) -> Column:
    """Percent over the value before; null without one above 0."""
    before = F.lag(value).over(order)
    return F.when(before > 0, F.round((value - before) / before * 100, digits))


def trend(records: DataFrame, metric: str = "production", period: str = "financial_year", by: list[str] | None = None) -> DataFrame:
    """(by..., period, value, record_count, target, achievement_pct, dispatch, growth_pct): a row a period.

    Growth goes by rounded values; target and achievement only where a target is above 0, dispatch likewise.
    """
    by = by or []
    # periods are parsed after the cells' spellings have been grouped
    rows = records.where(~F.col("is_error")).withColumn("spelt_", F.trim(F.col(period).cast("string"))).where("spelt_ is not null and spelt_ <> ''")
    spelt = rows.groupBy(*by, "spelt_").agg(*[F.sum(F.col(c).cast(EXACT)).alias(n) for n, c in (("value", metric), ("target", "target"), ("dispatch", "dispatch"))], F.count(metric).alias("record_count"))
    key = F.coalesce(scalars.format_financial_year(scalars.financial_year(F.col("spelt_"))), F.col("spelt_"))
    total = lambda c: F.round(F.sum(c), 2).cast("double")
    out = spelt.groupBy(*by, key.alias("period")).agg(F.coalesce(total("value"), F.lit(0.0)).alias("value"), F.sum("record_count").alias("record_count"), total("target").alias("target"), total("dispatch").alias("dispatch"))
    out = out.where("record_count > 0 or target is not null or dispatch is not null")
    out = out.withColumn("target", F.when(F.col("target") > 0, F.col("target"))).withColumn("dispatch", F.when(F.col("dispatch") > 0, F.col("dispatch")))
    return out.withColumn("achievement_pct", achievement(F.col("value"), F.col("target"))).withColumn("growth_pct", growth(F.col("value"), Window.partitionBy(*by).orderBy("period")))


def trend_summary(periods: DataFrame) -> DataFrame:
    """One row over (period, value): first and last period, whether there are two, and growth between them."""
    out = periods.agg(F.count("*").alias("periods"), F.min_by("value", "period").alias("first_value"), F.max_by("value", "period").alias("last_value"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    enough = F.col("periods") >= 2
    return out.withColumn("has_sufficient_history", enough).withColumn("overall_growth_pct", F.when(enough & (F.col("first_value") > 0), F.round((F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100, 2)))
