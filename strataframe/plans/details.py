"""Queries of smaller operators and column functions over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import scalars
from strataframe.operators import aggregates, answers, catalogue, cleaning, datasets, filters, lifecycle, quality, retrieval, schema
from strataframe.plans import binding
from strataframe.plans.queries import B, SQL, _questions, query
from strataframe.sources import writers
from strataframe.sources.staging import shared_dir


def _pick(c, *values):
    """One of ``values`` by a number from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))


# catalogues and lists


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = binding.table(spark, sf_dir, "supplier").join(binding.table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    k = F.col("s_suppkey")
    return s.select(k.alias("block_id"), F.col("s_name").alias("block_name"), F.initcap("n_name").alias("state"), F.when(k % 3 == 0, "Unallocated").otherwise(F.concat(F.lit("Company "), (k % 7).cast("string"))).alias("allocated_to"))


_BLOCKS = "b as (select s_suppkey block_id, s_name block_name, n_name state, case when s_suppkey % 3 = 0 then 'Unallocated' else 'Company ' || s_suppkey % 7 end allocated_to from supplier join nation on s_nationkey = n_nationkey)"


@query(f"with {_BLOCKS} select block_id, block_name from b where lower(allocated_to) = 'company 4' and (contains(lower(block_name), '1') or contains(lower(state), 'an')) and contains(lower(state), 'i')")
def block_filter(spark, sf_dir):
    return catalogue.matching(_blocks(spark, sf_dir), {"allocated_to": "COMPANY 4", "block_name": ""}, {"state": "I"}, "1", ["block_name"]).unionByName(
        catalogue.matching(_blocks(spark, sf_dir), {"allocated_to": "company 4"}, {"state": "i"}, "AN", ["state"])).select("block_id", "block_name").distinct()


@query(f"with {_BLOCKS} select count(*) total, count(*) filter (allocated_to = 'Unallocated') unallocated from b")
def block_totals(spark, sf_dir):
    return catalogue.block_summary(_blocks(spark, sf_dir))


@query("select c_custkey from customer join nation on c_nationkey = n_nationkey where contains(lower(c_mktsegment), 'build') and lower(n_name) = 'china' union select c_custkey from customer join nation on c_nationkey = n_nationkey where contains(lower(c_mktsegment), 'auto') or contains(lower(n_name), 'auto')")
def geology_reports(spark, sf_dir):
    """Reports of a theme and region, and those with a word in either."""
    r = binding.table(spark, sf_dir, "customer").join(binding.table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("theme"), F.col("n_name").alias("region"))
    return catalogue.matching(r, {"region": "China"}, {"theme": "Build"}).unionByName(catalogue.matching(r, search="AUTO", search_in=["theme", "region"])).select("c_custkey").distinct()


@query("select o_orderkey from orders where o_orderpriority = '2-HIGH' and o_orderstatus = 'F' order by o_orderkey desc limit 50")
def report_list(spark, sf_dir):
    o = binding.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("owner"), F.col("o_orderstatus").alias("kind"), F.timestamp_seconds("o_orderkey").alias("created_at"))
    return datasets.history(o, "2-HIGH", kind="F", status=None).select("o_orderkey")


@query("select o_orderkey document_id, o_orderstatus status from orders where o_orderkey < 40 and o_orderpriority = '2-HIGH'")
def status_polls(spark, sf_dir):
    """One owner asks for the status of forty documents, some of which are others'."""
    docs = binding.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("owner"), F.col("o_orderstatus").alias("status"))
    out = lifecycle.status_of(docs, "2-HIGH", 0)
    for i in range(1, 40):
        out = out.unionByName(lifecycle.status_of(docs, "2-HIGH", i))
    return out


@query("with t as (select *, count(*) over (partition by l_orderkey) n, row_number() over (partition by l_orderkey order by l_linenumber) - 1 i from (select distinct l_orderkey, l_linenumber from lineitem)) select l_orderkey, cast(i as bigint) place, least(3, floor(i / n * 3) + 1)::int page from t")
def page_estimates(spark, sf_dir):
    """Lines of an order as paragraphs of a document of three pages."""
    from pyspark.sql import Window

    of = Window.partitionBy("l_orderkey")
    t = binding.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumns({"n": F.count("*").over(of), "place": (F.row_number().over(of.orderBy("l_linenumber")) - 1).cast("long")})
    return t.select("l_orderkey", "place", datasets.estimated_page(F.col("place"), F.col("n"), F.lit(3)).alias("page"))


@query(f"with {B}, n as (select count(distinct row_index) n from v) select 'none' asked, 1 shown union all select 'many', least(200, n) from n union all select 'page', least(200, n) from n")
def limits_held(spark, sf_dir):
    """Limits below 1 and over 200 of groups and of a slice: one and two hundred."""
    r = filters.filter_records(binding.records(spark, sf_dir)).withColumn("row", F.col("row_index").cast("string"))
    shown = lambda name, df: df.agg(F.count("*").alias("shown")).select(F.lit(name).alias("asked"), "shown")
    few, many = aggregates.grouped(r, "row", "count", "production", limit=0), aggregates.grouped(r, "row", "count", "production", limit=9999)
    return shown("none", few).unionByName(shown("many", many)).unionByName(shown("page", catalogue.slice_of(r.select("row").distinct(), [F.col("row")], offset=-5, limit=10_000)))


@query(f"with {B} select subsidiary, count(*) n from v group by 1")
def filters_ignored(spark, sf_dir):
    """Filters of unknown columns and of the values all, empty and null are none."""
    r = filters.filter_records(binding.records(spark, sf_dir), {"subsidiary": "All", "mine": "", "grade": None, "unknown": "x", "status": "all"}, query="  ")
    return r.groupBy(filters.checked_field("subsidiary", r.columns)).agg(F.count("*").alias("n"))


@query("""with f as (select o_orderkey % 50 dataset_id, ['mine', 'grade', 'remarks', 'financial_year', 'tonnage'][o_orderkey % 5 + 1] field from orders) select distinct dataset_id, field, field in ('mine', 'grade', 'financial_year') filterable from f""")
def schema_columns(spark, sf_dir):
    o = binding.table(spark, sf_dir, "orders")
    return datasets.filterable(o.select((F.col("o_orderkey") % 50).alias("dataset_id"), _pick(F.col("o_orderkey") % 5, "mine", "grade", "remarks", "financial_year", "tonnage").alias("field")).distinct())


# column functions


@query("""with u as (select o_orderkey, ['12 MT', 'MT', 'kt', 'thousand tonnes', 'tonnes', 'kg', 'km', 'm', '%', 'furlong'][o_orderkey % 10 + 1] u from orders)
 select o_orderkey, case when u in ('km', 'm', '%') then u when u <> 'furlong' then 'MT' end base, case u when 'kt' then 1e-3 when 'thousand tonnes' then 1e-3 when 'tonnes' then 1e-6 when 'kg' then 1e-9 else 1.0 end::double scale from u""")
def unit_scales(spark, sf_dir):
    o = binding.table(spark, sf_dir, "orders").select("o_orderkey", _pick(F.col("o_orderkey") % 10, "12 MT", "MT", "kt", "thousand tonnes", "tonnes", "kg", "km", "m", "%", "furlong").alias("u"))
    return o.select("o_orderkey", scalars.normalized_unit(F.col("u")).alias("base"), scalars.unit_scale(F.col("u")).alias("scale"))


@query("""select doc_id, sha256(coalesce(text, '') || case when doc_id % 2 = 0 then '["' || source || '",null]' else '' end) h from documents""")
def fingerprints(spark, sf_dir):
    tables = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("source"), F.lit(None).cast("string")))
    return binding.table(spark, sf_dir, "documents").select("doc_id", scalars.document_fingerprint(F.col("text"), tables).alias("h"))


@query(r"""with s as (select doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from documents) select doc_id, len(s) n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) longest from s where s is not null""")
def sentence_counts(spark, sf_dir):
    d = binding.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", scalars.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then o_orderkey || ' Cr' when 1 then o_orderkey || '' when 2 then 'value ' || o_orderkey else '' end clean from orders""")
def clean_values(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("₹ "), k, F.lit(" Cr "))).when(k % 4 == 1, F.concat(F.lit(" n = "), k)).when(k % 4 == 2, F.concat(F.lit("value "), k)).otherwise(" n==? ")
    return binding.table(spark, sf_dir, "orders").select("o_orderkey", scalars.clean_value(raw).alias("clean"))


@query("""with s as (select o_orderkey, cast(floor(o_totalprice) as bigint) * [1, 1, 100, 100000][o_orderkey % 4 + 1] // case when o_orderkey % 4 = 0 then 1000 else 1 end n from orders)
 select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0) when n < 1073741824 then printf('%.1f MB', n / 1048576.0) else printf('%.1f GB', n / 1073741824.0) end size, 'Order ' || o_orderkey || '_a_.pdf' file from s""")
def sizes_and_names(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.floor("o_totalprice") * _pick(k % 4, 1, 1, 100, 100000)
    n = F.when(k % 4 == 0, F.floor(n / 1000)).otherwise(n).cast("long")
    return binding.table(spark, sf_dir, "orders").select("o_orderkey", scalars.file_size(n).alias("size"), scalars.safe_filename(F.concat(F.lit("/up/load\\Order "), k, F.lit(":a?.pdf"))).alias("file"))


@query("select o_orderkey, o_orderkey % 5 in (0, 3) coking from orders where o_orderkey % 5 <> 4 union all select o_orderkey, null from orders where o_orderkey % 5 = 4")
def coking_grades(spark, sf_dir):
    kind = _pick(F.col("o_orderkey") % 5, "Coking", "Non-Coking", "NON coking coal", "Prime COKING steel", None)
    return binding.table(spark, sf_dir, "orders").select("o_orderkey", scalars.is_coking(kind).alias("coking"))


# validation and cleaning


@query("""with t as (select o_orderkey k from orders), i as (select k, 'extraction_failure' issue_type, cast(null as int) row_index, cast(null as varchar) field_name from t where k % 3 = 0
 union all select k, 'schema_mismatch', 1, null from t where k % 3 = 1 union all select k, 'missing_required', null, unnest(['production', 'financial_year', 'subsidiary', 'organization']) from t where k % 3 <> 0)
 select cast(k as varchar) source_ref, issue_type, row_index, field_name from i""")
def empty_and_wide_tables(spark, sf_dir):
    """A table an order: nothing in it, a row with more cells than headers, or sound."""
    k = F.col("o_orderkey")
    cells = lambda *v: F.array(*[F.lit(x) for x in v])
    none = F.array().cast("array<array<string>>")
    rows = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(cells("a", "1"), cells("b", "2", "over"))).otherwise(F.array(cells("a", "1"), cells("b")))
    t = binding.table(spark, sf_dir, "orders").select(k.cast("string").alias("source_ref"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(cells("Mine", "Note")).alias("headers"), rows.alias("rows"))
    return quality.validate(t).select("source_ref", "issue_type", "row_index", "field_name")


@query("select n_nationkey record_id, n_name original_value, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') suggested_value from nation where contains(n_name, ' ') union all select 1000 + c_custkey, 'NEW ' || n_name, 'New ' || array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') from customer join nation on c_nationkey = n_nationkey")
def capital_names(spark, sf_dir):
    n = binding.table(spark, sf_dir, "nation")
    c = binding.table(spark, sf_dir, "customer").join(n, F.expr("c_nationkey = n_nationkey")).select((1000 + F.col("c_custkey")).alias("record_id"), F.lit("mine").alias("field"), F.concat(F.lit("NEW "), "n_name").alias("value"))
    cells = n.select(F.col("n_nationkey").cast("long").alias("record_id"), F.lit("state").alias("field"), F.col("n_name").alias("value")).unionByName(c)
    return cleaning.suggestions(cells).where("issue_type = 'capitalization'").select("record_id", "original_value", "suggested_value")


@query("""with o as (select o_orderkey k, o_orderkey % 4 m from orders), l as (select distinct l_orderkey k, l_linenumber n from lineitem)
 select k record_id, 'now ' || k || case when m = 1 then ' (was ' || k || ', before old)' else ' (was now ' || k || ')' end fields, coalesce((select string_agg('d' || n % 3 || ' S' || n, '|' order by n) from l where l.k = o.k), '') provenance,
 case m when 2 then 'ERROR open' else '' end findings, case m when 1 then 'production=8 applied|production=7 rejected' when 3 then 'production=9 pending' else '' end suggestions, m = 1 is_maintained from o""")
def details_of_records(spark, sf_dir):
    """Orders as records, their lines as provenance, with findings and suggestions by id."""
    o, k = binding.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id")), F.col("record_id")
    now = F.concat(F.lit("now "), k)
    kept = F.create_map(F.lit("production_original"), k.cast("string"), F.lit("production_original_before_apply"), F.lit("old"))
    records = o.select("record_id", F.when(k % 4 == 1, F.map_concat(F.create_map(F.lit("production"), now), kept)).otherwise(F.create_map(F.lit("production"), now)).alias("data"))
    line = F.col("l_linenumber").cast("string")
    provenance = binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), "l_linenumber").distinct().select("record_id", F.col("l_linenumber").alias("provenance_id"), F.concat(F.lit("d"), (F.col("l_linenumber") % 3).cast("string")).alias("document_id"), F.concat(F.lit("S"), line).alias("sheet_name"))
    findings = o.where("record_id % 4 = 2").select("record_id", k.alias("finding_id"), F.lit("negative").alias("issue_type"), F.lit("ERROR").alias("severity"), F.lit("open").alias("status"))
    made = lambda rest, i, value, status: o.where(f"record_id % 4 = {rest}").select("record_id", F.lit(i).alias("suggestion_id"), F.lit("production").alias("field_name"), F.lit(value).alias("suggested_value"), F.lit(status).alias("status"))
    suggestions = made(1, 1, "7", "rejected").unionByName(made(1, 2, "8", "applied")).unionByName(made(3, 1, "9", "pending"))
    d = schema.record_details(records, provenance, findings, suggestions)
    text = lambda c, f: F.array_join(F.transform(c, f), "|")
    return d.select(
        "record_id", text("fields", lambda x: F.concat(x["current"], F.lit(" (was "), x["original"], F.coalesce(F.concat(F.lit(", before "), x["before_apply"]), F.lit("")), F.lit(")"))).alias("fields"), text("provenance", lambda x: F.concat(x["document_id"], F.lit(" "), x["sheet_name"])).alias("provenance"),
        text("findings", lambda x: F.concat(x["severity"], F.lit(" "), x["status"])).alias("findings"), text("suggestions", lambda x: F.concat(x["field_name"], F.lit("="), x["suggested_value"], F.lit(" "), x["status"])).alias("suggestions"), "is_maintained")


# answers


@query("with s as (select n_chars % 17 / 10.0 score from documents where doc_id % 9 = 0) select case when max(score) >= 1.2 and count(*) >= 2 then 'HIGH' when max(score) >= 0.4 then 'MEDIUM' else 'LOW' end confidence from s")
def answer_confidence(spark, sf_dir):
    return retrieval.confidence(binding.table(spark, sf_dir, "documents").where("doc_id % 9 = 0").select((F.col("n_chars") % 17 / 10.0).alias("score")))


@query(f"""with a as ({SQL["answer_batch"]}), t as (select *, concat_ws(' ', case calculation when 'max' then 'Highest' when 'min' then 'Lowest' when 'avg' then 'Average' when 'sum' then 'Total' end, metric, 'of ' || coalesce(mine, subsidiary), 'in ' || "year") what from a)
 select question_id, what || ': ' || case when "value" is null then 'no data' else format('{{:,.2f}}', "value") || coalesce(' (' || name || ')', '') end answer from t""")
def answer_texts(spark, sf_dir):
    return answers.answered(_questions(spark, sf_dir), binding.order_records(spark, sf_dir)).select("question_id", "answer")


@query("""select o_orderkey row_index, cast(o_orderkey as varchar) "Mine", case when o_orderkey % 2 = 0 then 'x' end "late" from orders""")
def maintained_csv(spark, sf_dir):
    """Maps as a file with a column for each key, in the order in which they are first seen."""
    k = F.col("o_orderkey")
    base = F.create_map(F.lit("Mine"), k.cast("string"), F.lit("Mine_original_before_apply"), F.lit("old"))
    rows = binding.table(spark, sf_dir, "orders").select(k.alias("row_index"), k.alias("record_id"), F.when(k % 2 == 0, F.map_concat(base, F.create_map(F.lit("late"), F.lit("x")))).otherwise(base).alias("data"))
    path = f"{shared_dir(spark).rstrip('/')}/strataframe/{uuid.uuid4().hex}"
    writers.write_csv(writers.csv_rows(rows, writers.maintained_columns(rows)), path)
    return spark.read.csv(path, header=True, schema="row_index long, Mine string, late string")
