"""Catalogues of places, reports and blocks, and the audit log: filters, summaries and options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.aggregates import exact_sum, rounded_sum


def matching(rows: DataFrame, equal: dict[str, str | None] | None = None, within: dict[str, str | None] | None = None, search: str | None = None, search_in: list[str] | None = None) -> DataFrame:
    """Rows that equal and contain what is asked, whatever the case; ``search`` in any of some columns. Empty values are no filter."""
    tests = [F.lower(F.col(c)) == v.lower() for c, v in (equal or {}).items() if v]
    tests += [F.lower(F.col(c)).contains(v.lower()) for c, v in (within or {}).items() if v]
    if search and search_in:
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False)) for c in search_in]))
    return reduce(DataFrame.where, tests, rows)


def place_stats(mines: DataFrame) -> DataFrame:
    """One row over ``mines(subsidiary, state, coalfield, production)``."""
    return mines.agg(F.count("*").alias("mines"), rounded_sum(F.col("production")).alias("total_production"), F.round(exact_sum(F.col("production")) / F.count("production"), 3).alias("avg_production"), F.countDistinct("subsidiary").alias("subsidiaries"), F.countDistinct("state").alias("states"))


def counts_by(rows: DataFrame, by: str, value: str | None = None, top: int | None = None) -> DataFrame:
    """(grp, n[, total]), largest first."""
    more = [rounded_sum(F.col(value)).alias("total")] if value else []
    out = rows.where(F.col(by).isNotNull() & (F.trim(by) != "")).groupBy(F.col(by).alias("grp")).agg(F.count("*").alias("n"), *more)
    return out.orderBy(F.desc("n"), "grp").limit(top) if top else out


def block_summary(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count("*").alias("total"), F.count_if(F.lower("allocated_to") == "unallocated").alias("unallocated"))


def theme_summary(reports: DataFrame) -> DataFrame:
    """One row over ``reports(theme, region)``: all, and those whose theme names coal or lignite. ``counts_by`` gives the regions."""
    low = F.lower("theme")
    return reports.agg(F.count("*").alias("total"), F.count_if(low.contains("coal") | low.contains("lignite")).alias("coal_lignite"))


def first_themes(reports: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` distinct themes by name, ``null`` and empty ones left out."""
    return reports.select("theme").where("theme <> '' and theme <> 'null'").distinct().orderBy("theme").limit(n)


def choices(rows: DataFrame, fields: list[str], leave_out: tuple[str, ...] = ("null",)) -> DataFrame:
    """(field, value): distinct non-empty values."""
    tall = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    return tall.where("value is not null and trim(value) <> ''").where(~F.lower("value").isin(*leave_out)).distinct()


def slice_of(rows: DataFrame, order: list, offset: int = 0, limit: int = 50, most: int = 200) -> DataFrame:
    """A slice in order, its size from 1 to ``most``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def audit(events: DataFrame, event_type: str | None = None, actor: str | None = None, since: str | None = None, until: str | None = None, search: str | None = None, search_in: list[str] | None = None) -> DataFrame:
    """Events that match; dates are inclusive days, and one that is no date is no filter."""
    out = matching(events, {"actor": actor}, search=search, search_in=search_in)
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    day = F.to_date("timestamp")
    for bound, after in ((since, True), (until, False)):
        if bound:
            d = F.lit(bound).try_cast("date")
            out = out.where(F.coalesce(day >= d if after else day <= d, d.isNull()))
    return out
