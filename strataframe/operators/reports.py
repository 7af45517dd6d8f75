"""Tables of the standard reports. Each takes valid, filtered records and gives one table; prose is left to the reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import scalars
from strataframe.operators.aggregates import EXACT, achievement, rounded_sum
from strataframe.operators.filters import filter_records
from strataframe.operators.trends import trend

# Organizations that mean all subsidiaries.
WHOLE = ("CMPDI (HQ)", "All", "All / CMPDI", "CIL (National)")


def scope(records: DataFrame, organization: str | None = None, years: list[str] | None = None) -> DataFrame:
    """Valid records of a subsidiary (or all) and of some financial years (or all)."""
    out = filter_records(records, {"subsidiary": None if organization in WHOLE else organization})
    if years:
        key = scalars.format_financial_year(scalars.financial_year(F.col("financial_year")))
        out = out.where(key.isin([y for y in years]))
    return out


def _sum(name: str) -> Column:
    return F.coalesce(rounded_sum(F.col(name)), F.lit(0.0))


def _first(name: str, n: int) -> Column:
    return F.array_join(F.slice(F.array_sort(F.collect_set(name)), 1, n), ", ")


def _upper(name: str, empty: str) -> Column:
    return F.upper(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(empty)))


def _share(value: str) -> Column:
    every = F.sum(F.col(value).cast(EXACT)).over(Window.partitionBy()).cast("double")
    return F.when(every > 0, F.round(F.col(value) / every * 100, 1)).otherwise(0.0)


def production(r: DataFrame) -> DataFrame:
    out = r.groupBy(_upper("subsidiary", "OTHER").alias("subsidiary")).agg(_sum("production").alias("production"), _sum("target").alias("target"), _sum("dispatch").alias("dispatch"), F.countDistinct("mine").alias("mines"))
    return out.withColumn("achievement_pct", achievement(F.col("production"), F.col("target")))


def top_mines(r: DataFrame, n: int = 10) -> DataFrame:
    return r.groupBy("mine").agg(_sum("production").alias("production")).orderBy(F.desc("production"), "mine").limit(n)


def production_years(r: DataFrame) -> DataFrame:
    """Production, target, dispatch and growth by financial year."""
    return trend(r).select("period", F.col("value").alias("production"), "target", "dispatch", "growth_pct")


def geological(r: DataFrame) -> DataFrame:
    return r.groupBy("coalfield").agg(_first("state", 100).alias("states"), F.countDistinct("mine").alias("mines"), _first("grade", 4).alias("grades"), _sum("production").alias("production"))


def grades(r: DataFrame) -> DataFrame:
    out = r.groupBy("grade").agg(_first("coal_type", 100).alias("types"), F.count("*").alias("records"), _sum("production").alias("production"), F.max(scalars.is_coking(F.col("coal_type"))).alias("coking"))
    return out.withColumn("share_pct", _share("production"))


def mining_performance(r: DataFrame, n: int = 12) -> DataFrame:
    """The largest rows by production, with variance to target, achievement and dispatch ratio; missing figures count 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = r.select("record_id", "row_index", "mine", z("production").alias("production"), z("target").alias("target"), z("dispatch").alias("dispatch"))
    out = out.orderBy(F.desc("production"), "row_index", "record_id").limit(n)
    return out.withColumn("variance", F.round(F.col("production") - F.col("target"), 2)).withColumn("achievement_pct", achievement(F.col("production"), F.col("target"))).withColumn("dispatch_pct", achievement(F.col("dispatch"), F.col("production"))).withColumn("standing", F.when(F.col("variance") >= 0, "surplus").otherwise("deficit")).drop("row_index")


def exploration(r: DataFrame, n: int = 10) -> DataFrame:
    """Areas (block, else project, else mine) by number of rows, with their last coalfield and state and up to three seams."""
    last = lambda c: F.max_by(c, F.struct("row_index", "record_id"))
    area = F.coalesce("block", "project", "mine")
    out = r.withColumn("area", area).where("area is not null").groupBy("area").agg(last("coalfield").alias("coalfield"), last("state").alias("state"), F.count("*").alias("records"), _first("seam", 3).alias("seams"))
    return out.orderBy(F.desc("records"), "area").limit(n)


def coal_seam(r: DataFrame) -> DataFrame:
    out = r.groupBy("grade").agg(_first("coal_type", 100).alias("types"), _first("coalfield", 2).alias("coalfields"), F.countDistinct("mine").alias("mines"), _sum("production").alias("production"))
    return out.withColumn("share_pct", _share("production"))


def parliamentary(r: DataFrame) -> DataFrame:
    out = r.groupBy(_upper("subsidiary", "OTHER").alias("subsidiary")).agg(_sum("target").alias("target"), _sum("production").alias("production"), _sum("dispatch").alias("dispatch"))
    return out.withColumn("achievement_pct", achievement(F.col("production"), F.col("target")))


def administrative(r: DataFrame) -> DataFrame:
    return r.groupBy(_upper("subsidiary", "HQ").alias("subsidiary")).agg(F.countDistinct("mine").alias("mines"), F.count("*").alias("records"), _sum("production").alias("production"), _sum("dispatch").alias("dispatch"))


def custom(r: DataFrame) -> DataFrame:
    return r.groupBy(_upper("subsidiary", "OTHER").alias("subsidiary")).agg(_first("coalfield", 2).alias("coalfields"), F.countDistinct("mine").alias("mines"), _sum("production").alias("production"), _sum("dispatch").alias("dispatch"), _sum("target").alias("target"))


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "production": production, "production_years": production_years, "top_mines": top_mines, "geological": geological, "grades": grades, "mining_performance": mining_performance,
    "exploration": exploration, "coal_seam": coal_seam, "parliamentary": parliamentary, "administrative": administrative, "custom": custom,
}


def report(kind: str, records: DataFrame, organization: str | None = None, years: list[str] | None = None) -> DataFrame:
    """A report's table. A production report whose scope matches nothing falls back to all rows, marked ``is_fallback``."""
    if kind not in REPORTS:
        raise ValueError(f"unknown report: {kind}")
    rows = scope(records, organization, years)
    if kind != "production":
        return REPORTS[kind](rows)
    empty = rows.isEmpty()
    return production(records if empty else rows).withColumn("is_fallback", F.lit(empty))


def provenance_of(records: DataFrame, provenance: DataFrame, n: int = 50) -> DataFrame:
    """Provenance of a report's first records."""
    first = records.orderBy("row_index", "record_id").limit(n).select("record_id")
    return provenance.join(first, "record_id", "left_semi")


#: What may follow each status of a report.
NEXT_STATUS = {"GENERATING": ("GENERATED", "FAILED"), "GENERATED": ("UNDER_REVIEW", "VERIFIED", "APPROVED"), "UNDER_REVIEW": ("VERIFIED", "APPROVED"), "VERIFIED": ("APPROVED", "EXPORTED"), "APPROVED": ("EXPORTED",)}


def moved(reports: DataFrame, moves: DataFrame) -> DataFrame:
    """``reports(report_id, status)`` after ``moves(report_id, to)``; moves that may not be made change nothing."""
    allowed = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.array(*map(F.lit, v))) for k, v in NEXT_STATUS.items()]))
    out = reports.join(moves, "report_id", "left")
    return out.withColumn("status", F.when(F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("status")), F.array().cast("array<string>")), F.col("to")), F.col("to")).otherwise(F.col("status"))).drop("to")
