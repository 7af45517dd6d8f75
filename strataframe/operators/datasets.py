"""Whole datasets: totals of key-value rows, years by dataset, profiles of sources, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import scalars, vocab
from strataframe.operators.aggregates import achievement, rounded_sum
from strataframe.operators.retrieval import _plain_tokens
from strataframe.operators.trends import growth


def label_metric(label: Column) -> Column:
    """Which of the three measures a key-value row's label names: a target before all, then production, then dispatch."""
    low = F.lower(label)
    return F.when(low.contains("target"), "target").when(low.contains("production"), "production").when(low.contains("dispatch"), "dispatch")


def measured(rows: DataFrame) -> DataFrame:
    """``rows(label, value, ...)`` with ``metric`` and ``number``; rows whose label names no measure or whose value is no number go."""
    return rows.withColumn("metric", label_metric(F.col("label"))).withColumn("number", scalars.parse_numeric(F.col("value"))).where("metric is not null and number is not null")


def key_value_totals(rows: DataFrame) -> DataFrame:
    """(metric, total): what a missing column total falls back to."""
    return measured(rows).groupBy("metric").agg(rounded_sum(F.col("number")).alias("total"))


def dataset_totals(rows: DataFrame) -> DataFrame:
    """(dataset_id, metric, total): the sum of a dataset's component rows if it has any, else of its summary rows (label with ``total``)."""
    summary = F.lower("label").contains("total")
    part, whole = rounded_sum(F.when(~summary, F.col("number"))), rounded_sum(F.when(summary, F.col("number")))
    return measured(rows).groupBy("dataset_id", "metric").agg(F.coalesce(part, whole).alias("total"))


def dataset_years(rows: DataFrame) -> DataFrame:
    """(dataset_id, year): the financial year of the first row, in row order, that has one."""
    year = scalars.format_financial_year(scalars.financial_year(F.col("financial_year")))
    return rows.withColumn("y", year).where("y is not null").groupBy("dataset_id").agg(F.min_by("y", F.struct("row_index", "record_id")).alias("year"))


#: Labels of key-value rows that hold a year.
_YEAR_LABELS = ("year", "financial year", "financial_year", "period")


def record_years(rows: DataFrame) -> DataFrame:
    """``rows(financial_year, year, label, value, title, filename, ...)`` with ``fy``: the row's own financial year, else its ``year``, else the value of a row
    labelled a year, else the one year that the document's title and file name agree on.
    """
    parse = lambda c: scalars.format_financial_year(scalars.financial_year(F.col(c)))
    labelled = F.when(F.lower(F.trim("label")).isin(*_YEAR_LABELS), parse("value"))
    title, name = parse("title"), parse("filename")
    of_document = F.when(title.isNull() | name.isNull() | (title == name), F.coalesce(title, name))
    own = F.coalesce(F.nullif("financial_year", F.lit("")), F.col("year"))
    return rows.withColumn("fy", F.coalesce(scalars.format_financial_year(scalars.financial_year(own)), labelled, of_document))


def trend_from_datasets(rows: DataFrame, metric: str = "production") -> DataFrame:
    """(period, value, growth_pct): datasets' totals by their years, for sources that have only key-value rows."""
    out = dataset_totals(rows).where(F.col("metric") == metric).join(dataset_years(rows), "dataset_id").groupBy(F.col("year").alias("period")).agg(rounded_sum(F.col("total")).alias("value"))
    return out.withColumn("growth_pct", growth(F.col("value"), Window.orderBy("period")))  # a row a year


def report_aggregates(rows: DataFrame) -> DataFrame:
    """One row: production, target and dispatch over datasets, achievement to 2 places, and how many mines and subsidiaries the rows name."""
    t = dataset_totals(rows)
    named = rows.agg(F.countDistinct(F.nullif(F.trim("mine"), F.lit(""))).alias("mines") if "mine" in rows.columns else F.lit(0).cast("long").alias("mines"), F.countDistinct(F.nullif(F.upper(F.trim("subsidiary")), F.lit(""))).alias("subsidiaries"))
    out = t.agg(*[rounded_sum(F.when(F.col("metric") == m, F.col("total"))).alias(m) for m in ("production", "target", "dispatch")])
    out = out.withColumn("achievement_pct", achievement(F.col("production"), F.col("target"), 2))
    return out.withColumn("n_", named.agg(F.first(F.struct("mines", "subsidiaries"))).scalar()).select("*", "n_.*").drop("n_")


def source_profile(rows: DataFrame) -> DataFrame:
    """(subsidiary, metric, value): a source's figure for each subsidiary, the last row's winning."""
    return measured(rows).groupBy(F.upper(F.trim("subsidiary")).alias("subsidiary"), "metric").agg(F.max_by("number", F.struct("row_index", "record_id")).alias("value"))


def listing(fields: DataFrame) -> DataFrame:
    """``fields(dataset_id, field)`` to a row a dataset with flags for what it can be asked."""
    has = lambda c: F.bool_or(scalars.concept(F.col("field")) == c)
    return fields.groupBy("dataset_id").agg(F.count("*").alias("columns"), *[F.coalesce(has(c), F.lit(False)).alias(f"has_{c}") for c in ("production", "target", "dispatch", "financial_year")])


def filterable(fields: DataFrame) -> DataFrame:
    return fields.withColumn("filterable", F.col("field").isin(*vocab.OPTION_FIELDS))


def estimated_page(index: Column, total: Column, pages: Column) -> Column:
    """Page of a paragraph by its place among all: 1 to ``pages``."""
    return F.least(pages, (F.floor(index / total * pages) + 1).cast("int"))


def candidates(chunks: DataFrame, query: str, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """Chunks that hold one of the query's first five tokens in content or heading; the first ``most`` by key, if a cap is wanted."""
    test = F.lit(False)
    for w in _plain_tokens(query)[:5]:
        test = test | F.lower("content").contains(w)
        if "section_heading" in chunks.columns:
            test = test | F.coalesce(F.lower("section_heading").contains(w), F.lit(False))
    out = chunks.where(test)
    return out if most is None else out.orderBy(key).limit(most)


def findings_in_order(findings: DataFrame, status: str | None = None, issue_type: str | None = None) -> DataFrame:
    """Findings by severity from the end of the alphabet (WARNING, INFO, ERROR), then by type; of one status or type where given."""
    out = findings
    for c, v in (("status", status), ("issue_type", issue_type)):
        if v:
            out = out.where(F.col(c) == v)
    return out.orderBy(F.desc("severity"), "issue_type")


#: Orders that a list of documents may have.
_LIST_ORDERS = ("created_at", "title", "status", "length")


def document_list(documents: DataFrame, owner: str, status: str | None = None, search: str | None = None, order: str = "-created_at") -> DataFrame:
    """The owner's documents that are not archived, of a status and with ``search`` in title or file name where given. An order that is not allowed is the newest first."""
    out = documents.where((F.col("owner") == owner) & ~F.col("is_archived"))
    if status:
        out = out.where(F.col("status") == status)
    if search and search.strip():
        low = search.strip().lower()
        out = out.where(F.lower("title").contains(low) | F.lower("filename").contains(low))
    name = order.lstrip("-")
    key = F.col(name) if name in _LIST_ORDERS else F.col("created_at")
    return out.orderBy(key.desc() if order.startswith("-") or name not in _LIST_ORDERS else key.asc(), "document_id")


def history(rows: DataFrame, owner: str, when: str = "created_at", n: int = 50, **equal: str | None) -> DataFrame:
    """The owner's own rows, newest first: questions asked, reports, findings; other columns by exact value where given."""
    out = rows.where(F.col("owner") == owner)
    for c, v in equal.items():
        if v:
            out = out.where(F.col(c) == v)
    return out.orderBy(F.desc(when)).limit(n)
