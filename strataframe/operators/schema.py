"""From raw table rows to records: concepts of columns, normalised cells, fields and their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import scalars, vocab


def column_map(headers: DataFrame) -> DataFrame:
    """``headers(header)`` to (header, concept, confidence)."""
    c = scalars.concept(F.col("header"))
    return headers.select("header", c.alias("concept"), F.when(c.isNotNull(), 0.85).otherwise(0.0).alias("confidence"))


def columns_of(headers: Column) -> Column:
    """Array of struct(header, concept, key) of a table's headers: what a column means, found once for all its rows, and the key of its cells."""
    return F.transform(headers, lambda h: scalars.let(scalars.concept(h), lambda c: F.struct(h.alias("header"), c.alias("concept"), F.coalesce(c, h, F.lit("")).alias("key"))))


def normalized_rows(tables: DataFrame) -> DataFrame:
    """``tables(source_ref, headers, rows)`` to (source_ref, row_index, data map): keys are concepts or raw names, with ``_original``,
    ``_unit`` and ``_normalized_unit`` beside them, in the order of the headers; of two headers with one key the last that has a value wins; short rows are padded.

    A row is made from its own table's row: nothing is shuffled.
    """
    rows = tables.select("source_ref", columns_of(F.col("headers")).alias("columns"), "rows").select("source_ref", "columns", F.posexplode("rows").alias("row_index", "cells"))
    value = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    normal = F.transform("columns", lambda c, i: F.struct(c["key"].alias("key"), scalars.normalize_cell(value(i), F.coalesce(c["concept"], F.lit(""))).alias("n")))
    entry = lambda x, suffix, field: F.struct(F.concat(x["key"], F.lit(suffix)).alias("key"), x["n"][field].alias("value"))
    each = F.flatten(F.transform(normal, lambda x: F.array(entry(x, "", "value"), entry(x, "_original", "original"), entry(x, "_unit", "unit"), entry(x, "_normalized_unit", "normalized_unit"))))
    keys = lambda e: F.array_distinct(F.transform(e, lambda x: x["key"]))
    last = lambda e, ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(F.filter(e, lambda x: x["key"] == k), -1)["value"]))
    # cells are normalised once, though their entries are named often
    data = scalars.let(F.filter(each, lambda x: x["value"].isNotNull()), lambda e: scalars.let(keys(e), lambda ks: F.when(F.size(ks) == F.size(e), F.map_from_entries(e)).otherwise(last(e, ks))))
    return rows.select("source_ref", "row_index", data.alias("data"))


def fields(records: DataFrame, rows: int = 100) -> DataFrame:
    """(field, type) of ``records(row_index, data)``: numeric by name, or if the first value seen in the first rows is a number; else categorical."""
    first = records.orderBy("row_index").limit(rows).select("row_index", F.explode(F.map_entries("data")).alias("e")).select("row_index", "e.key", "e.value")
    first = first.where("value is not null and not (key like '%\\_original' or key like '%\\_unit')")
    out = first.groupBy("key").agg(F.min_by("value", "row_index").alias("seen"))
    numeric = F.col("key").isin(*vocab.NUMERIC_FIELDS) | (~F.col("key").isin(*vocab.DIMENSIONS) & scalars.parse_numeric(F.col("seen")).isNotNull())
    return out.select(F.col("key").alias("field"), F.when(numeric, "numeric").otherwise("categorical").alias("type"))


def filled(data: Column, name: str) -> Column:
    """A schema column's cell, else that of its lower-cased name, else the original under it."""
    low = name.lower()
    return F.coalesce(F.try_element_at(data, F.lit(name)), F.try_element_at(data, F.lit(low)), F.try_element_at(data, F.lit(f"{low}_original")))


def detail(records: DataFrame) -> DataFrame:
    """A row a field of each record: (record_id, field, current, original, before_apply, was_maintained)."""
    keys = F.filter(F.map_keys("data"), lambda k: ~k.rlike("(_original|_unit|_normalized_unit|_before_apply)$"))
    out = records.select("record_id", "data", F.explode(keys).alias("field"))
    get = lambda suffix: F.try_element_at("data", F.concat("field", F.lit(suffix)))
    return out.select("record_id", "field", get("").alias("current"), get("_original").alias("original"), get("_original_before_apply").alias("before_apply"), get("_original_before_apply").isNotNull().alias("was_maintained"))


def record_details(records: DataFrame, provenance: DataFrame, findings: DataFrame, suggestions: DataFrame) -> DataFrame:
    """A row a record with everything known of it: (record_id, fields, provenance, findings, suggestions, is_maintained).

    ``fields`` are its cells but for the kept originals, each with its value now, the original (the value itself where none was kept), and the value before a correction. ``provenance(record_id,
    provenance_id, document_id, sheet_name)``, ``findings(record_id, finding_id, issue_type, severity, status)`` and ``suggestions(record_id, suggestion_id, field_name, suggested_value, status)`` are listed by id, the
    newest suggestion first. A record is maintained if a suggestion for it was applied. The lists are those of one record.
    """
    keys = F.filter(F.map_keys("data"), lambda k: ~k.rlike("(_original|_original_before_apply)$"))
    get = lambda k, suffix: F.try_element_at("data", F.concat(k, F.lit(suffix)))
    cell = lambda k: F.struct(k.alias("field"), F.coalesce(F.try_element_at("data", k), F.lit("")).alias("current"), F.coalesce(get(k, "_original"), F.try_element_at("data", k), F.lit("")).alias("original"), get(k, "_original_before_apply").alias("before_apply"))
    out = records.select("record_id", F.transform(keys, cell).alias("fields"))
    applied = F.bool_or(F.col("status") == "applied").alias("is_maintained")
    sides = {
        "provenance": provenance.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("provenance_id", "document_id", "sheet_name"))).alias("provenance")),
        "findings": findings.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("finding_id", "issue_type", "severity", "status"))).alias("findings")),
        "suggestions": suggestions.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("suggestion_id", "field_name", "suggested_value", "status")), asc=False).alias("suggestions"), applied),
    }
    for name, side in sides.items():
        out = out.join(side, "record_id", "left").withColumn(name, F.coalesce(name, F.array().cast(side.schema[name].dataType)))
    return out.withColumn("is_maintained", F.coalesce("is_maintained", F.lit(False)))


def first_provenance(records: DataFrame, provenance: DataFrame) -> DataFrame:
    """Records with their first provenance row (by ``provenance_id``), where there is one."""
    one = provenance.withColumn("n_", F.row_number().over(Window.partitionBy("record_id").orderBy("provenance_id"))).where("n_ = 1").drop("n_")
    return records.join(one, "record_id", "left")


def drilldown(records: DataFrame, provenance: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Records with all their provenance rows, as text in order; with ``documents(document_id, title)`` their titles too."""
    if documents is not None:
        titled = provenance.join(documents.select("document_id", "title"), "document_id", "left")
        titles = titled.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("provenance_id", F.coalesce("title", F.lit("")).alias("title")))), lambda x: x["title"]), "|").alias("titles"))
        records = records.join(titles, "record_id", "left")
    every = provenance.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("provenance_id", "sheet_name"))), lambda x: x["sheet_name"]), "|").alias("sheets"), F.count("*").alias("provenance_count"))
    return records.join(every, "record_id", "left").withColumn("provenance_count", F.coalesce("provenance_count", F.lit(0)))


# Where a document's year, mine, organization and location are given, in order: names among what is given with it, words of a key in a key-value
# table (and the one-word heads of such tables' first column), and patterns of its title, file name and text, group 1 of which is the value.
KEY_HEADS = ("field", "key", "property", "metric", "parameter")
METADATA = {
    "financial_year": (("financial_year", "reporting_year", "year", "fy"), ("year", "financial year", "reporting year", "fy"), (
        r"(?i)(?:Reporting\s+Year|Financial\s+Year|Year|FY)\s*[:\-=]?\s*(FY\s*\d{2,4}[-–/]\d{2,4}|\d{4}[-–/]\d{2,4}|\bFY\d{2,4}\b)", r"(?i)(\b(?:FY\s*20\d{2}[-–/]\d{2,4}|20\d{2}[-–/]\d{2})\b)")),
    "mine": (("mine", "mine_name", "name_of_mine"), ("mine",), (r"(?i)(?:Mine\s+Name|Name\s+of\s+Mine|Mine)\s*[:\-=]\s*([^\r\n,]+)",)),
    "organization": (("organization", "company", "subsidiary", "source", "operator", "owner"), ("organization", "company", "subsidiary", "source", "operator"), (
        r"(?i)(?:Organization|Company|Source|Operator|Owner|Corporation|Ministry)\s*[:\-=]\s*([^\r\n]+)", r"(?i)(\b(?:Coal India(?: Limited)?|CIL|CMPDI|CMPDIL|MCL|NCL|SECL|ECL|CCL|WCL|BCCL|SCCL|NLC|Ministry of Coal)\b)")),
    "location": (("location", "place", "district", "state"), ("location", "place", "district", "state"), (r"(?i)Location\s*[:\-=]\s*([^\r\n]+)",)),
}
ORGANIZATION_HEADERS = ("subsidiary", "organization", "company", "psu")


def metadata_evidence(documents: DataFrame) -> DataFrame:
    """Every piece of evidence for a document's year, mine, organization and location: (document_id, field, source, place, value).

    ``documents(document_id, title, filename, raw_text, given map, tables array<struct<headers, rows>>)``. ``source`` ranks them: 1 given with the document, 2 a key-value table, 3 a pattern of title, file name and
    text, 4 a table's header (for the organization); ``place`` orders those of one source.
    """
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("filename", F.lit("")), F.coalesce("raw_text", F.lit("")))
    one = lambda source, place, value: F.struct(F.lit(source).alias("source"), F.lit(place).alias("place") if isinstance(place, int) else place.alias("place"), F.nullif(F.trim(value), F.lit("")).alias("value"))
    low = lambda c: F.lower(F.trim(c))
    # rows of tables with two columns, the first of which is headed as a key; of rows with one key the last counts, in the place of the first
    kv = F.filter(F.coalesce("tables", F.array().cast(documents.schema["tables"].dataType)), lambda t: (F.size(t["headers"]) == 2) & low(t["headers"][0]).rlike("|".join(KEY_HEADS)))
    full = lambda c: F.coalesce(c != "", F.lit(False))
    pair = lambda r: F.when(full(F.get(r, 0)) & full(F.get(r, 1)), F.struct(low(F.get(r, 0)).alias("key"), F.trim(F.get(r, 1)).alias("value")))
    pairs = F.filter(F.flatten(F.transform(kv, lambda t: F.transform(t["rows"], lambda r: pair(r)))), lambda p: p.isNotNull())
    docs = documents.select("document_id", "given", text.alias("text"), pairs.alias("pairs"), F.transform(F.flatten(F.transform("tables", lambda t: t["headers"])), lambda h: F.trim(h)).alias("heads"))
    docs = docs.withColumn("keys", F.array_distinct(F.transform("pairs", lambda p: p["key"])))

    def of(field: str, names: tuple[str, ...], words: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
        last = lambda k: F.element_at(F.filter("pairs", lambda p: p["key"] == k), -1)["value"]
        given = [one(1, i, F.try_element_at("given", F.lit(n))) for i, n in enumerate(names)]
        shown = [one(3, i, F.regexp_extract("text", p, 1)) for i, p in enumerate(patterns)]
        every = F.concat(F.array(*given, *shown), F.transform("keys", lambda k, i: F.when(k.rlike("|".join(words)), one(2, i, last(k)))))
        if field == "organization":
            every = F.concat(every, F.transform(F.coalesce("heads", F.array().cast("array<string>")), lambda h, i: F.when(F.lower(h).isin(*ORGANIZATION_HEADERS), one(4, i, h))))
        return F.transform(F.filter(every, lambda x: x["value"].isNotNull()), lambda x: F.struct(F.lit(field).alias("field"), x["source"].alias("source"), x["place"].alias("place"), x["value"].alias("value")))

    found = [of(field, *known) for field, known in METADATA.items()]
    return docs.select("document_id", F.inline(F.concat(*found)))


def document_metadata(documents: DataFrame) -> DataFrame:
    """(document_id, field, value, origin): the best ranked evidence of each field (``metadata_evidence``), one row a field that has any."""
    best = F.min(F.struct("source", "place", "value"))
    out = metadata_evidence(documents).groupBy("document_id", "field").agg(best.alias("best"))
    origin = F.element_at(F.array(*map(F.lit, ("given", "table", "text", "header"))), F.col("best.source"))
    return out.select("document_id", "field", F.col("best.value").alias("value"), origin.alias("origin"))


def first_seen(records: DataFrame, column: str = "data", order: tuple[str, ...] = ("row_index", "record_id"), by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, place): the keys of the records' maps in the order in which they are first seen, records in ``order`` and keys in that of their map; for each ``by`` where it is given."""
    at = [c for c in order if c in records.columns]
    seen = records.select(*by, *at, F.posexplode(F.map_keys(column)).alias("place_", "key")).groupBy(*by, "key").agg(F.min(F.struct(*at, "place_")).alias("at_"))
    return seen.select(*by, "key", F.row_number().over(Window.partitionBy(*by).orderBy("at_", "key")).alias("place"))  # a row a key, and keys are a schema
