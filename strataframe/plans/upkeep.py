"""Queries of sources, sinks, scopes and upkeep over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.functions import scalars
from strataframe.operators import aggregates, answers, catalogue, cleaning, compare, datasets, filters, lifecycle, quality, reports, retrieval, schema
from strataframe.plans import binding
from strataframe.plans.queries import B, C, O, S, Z, query
from strataframe.sources import readers, split_csv, writers
from strataframe.sources.staging import shared_dir, stored


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strataframe/{uuid.uuid4().hex}"


# sources and sinks: what is written is read back


@query("select s_suppkey, s_name, s_nationkey from supplier")
def csv_write_and_scan(spark, sf_dir):
    path = _folder(spark)
    writers.write_csv(binding.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    rows = readers.tables(readers.files(spark, path, "csv")).select(F.explode("rows").alias("r"))
    return rows.select(F.col("r")[0].cast("long").alias("s_suppkey"), F.col("r")[1].alias("s_name"), F.col("r")[2].cast("int").alias("s_nationkey"))


@query("select o_orderkey, o_orderpriority || chr(10) || '\"' || o_orderstatus || '\", ' || o_custkey note from orders")
def csv_split_scan(spark, sf_dir):
    """Orders with quotes, line ends and delimiters in their cells, each file read by as many tasks as it has splits."""
    path = _folder(spark)
    note = F.concat("o_orderpriority", F.lit("\n\""), "o_orderstatus", F.lit("\", "), "o_custkey")
    rows = binding.table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"))
    rows.write.option("escape", "\"").csv(path, header=True)
    found = split_csv.csv_records(spark, path)
    return found.select(F.col("cells")[0].cast("long").alias("o_orderkey"), F.col("cells")[1].alias("note"))


@query("select s_suppkey, s_name, cast(s_acctbal as double) s_acctbal from supplier")
def xlsx_write_and_scan(spark, sf_dir):
    books = stored(writers.workbooks(binding.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), ["s_suppkey"], most=40), spark)
    rows = readers.tables(books).where("sheet_name = 'Data'").select(F.explode("rows").alias("r"))
    return rows.select(F.col("r")[0].cast("long").alias("s_suppkey"), F.col("r")[1].alias("s_name"), F.col("r")[2].cast("double").alias("s_acctbal"))


def _documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of four kinds by id."""
    kind = F.element_at(F.array(*map(F.lit, ("txt", "csv", "pdf", "exe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    d = binding.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "doc_id", kind).alias("path"), kind.alias("extension"), content.alias("content"))
    return d.withColumn("length", F.octet_length("content").cast("long")).withColumn("signature_ok", scalars.signature_ok(F.col("extension"), F.col("content")))


@query("select doc_id, length(coalesce(text, '')) n, sha256(coalesce(text, '')) h from documents where doc_id % 4 = 0")
def text_scan(spark, sf_dir):
    found = readers.texts(_documents_as_files(spark, sf_dir))
    return found.select(F.split("path", r"\.")[0].cast("long").alias("doc_id"), F.length("raw_text").cast("long").alias("n"), F.sha2("raw_text", 256).alias("h"))


@query("""with f as (select doc_id % 4 k, coalesce(text, '') t from documents), r as (select case when k = 3 then 'extension' when strlen(t) > 20000 then 'size' when t = '' then 'empty'
  when k = 2 and not starts_with(t, '%PDF') then 'signature' else 'admitted' end verdict from f) select verdict, count(*) n from r group by 1""")
def upload_admission(spark, sf_dir):
    good, bad = readers.admitted(_documents_as_files(spark, sf_dir), most=20_000)
    return good.select(F.lit("admitted").alias("verdict")).unionByName(bad.select(F.col("reason").alias("verdict"))).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""with b as (select doc_id // 7 batch_id, count(*) files, cast(sum(strlen(coalesce(text, ''))) as bigint) bytes from documents group by 1)
 select *, case when files > 6 then 'count' when bytes > 8000 then 'size' end reason from b""")
def upload_batches(spark, sf_dir):
    files = binding.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 7).alias("batch_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return lifecycle.batches(files, 6, 8000)


@query(f"""with {O}, n as (select record_id % 5 document_id, count(*) n, {S('production')} total from o group by 1) select document_id, case when document_id < 2 then 2 * n else n end n, case when document_id < 2 then 2 * total else total end total from n""")
def replaced_documents(spark, sf_dir):
    """Five documents are written; two of them are replaced by twice their rows, and the others' partitions stay."""
    path = _folder(spark)
    rows = binding.order_records(spark, sf_dir).select((F.col("record_id") % 5).alias("document_id"), "record_id", "production")
    writers.replace_documents(rows, path)
    again = rows.where("document_id < 2")
    writers.replace_documents(again.unionByName(again), path)
    total = F.round(F.sum(F.col("production").cast("decimal(28,8)")), 2).cast("double")
    return spark.read.parquet(path).groupBy(F.col("document_id").cast("long").alias("document_id")).agg(F.count("*").alias("n"), total.alias("total"))


@query("select event_type, 2 * count(*) n from events group by 1")
def appended_log(spark, sf_dir):
    path, e = _folder(spark), binding.table(spark, sf_dir, "events").select("event_id", "event_type")
    for _ in range(2):
        writers.append(e, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


_OWNED = """w as (select o_orderkey record_id, o_orderkey % 50 document_id, o_orderkey % 50 dataset_id, o_orderpriority as owner, o_orderkey % 7 = 0 is_reference, o_orderkey % 11 = 0 is_archived, o_totalprice from orders)"""


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return binding.table(spark, sf_dir, "orders").select(k.alias("record_id"), (k % 50).alias("document_id"), (k % 50).alias("dataset_id"), F.col("o_orderpriority").alias("owner"), (k % 7 == 0).alias("is_reference"), (k % 11 == 0).alias("is_archived"), "o_totalprice")


@query(f"""with {_OWNED}, g as (select is_archived or (document_id < 10 and not is_reference) a, not is_reference and document_id in (3, 20) gone from w)
 select a is_archived, count(*) n from g where not gone group by 1""")
def archived_and_removed(spark, sf_dir):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "document_id long")
    rows = writers.removed(writers.archived(_owned(spark, sf_dir), ids(*range(10))), ids(3, 20))
    return rows.groupBy("is_archived").agg(F.count("*").alias("n"))


@query(f"""with {_OWNED}, m as (select * from w where owner = '2-HIGH' and not is_archived)
 select 'all' scope, count(*) n from m union all select 'baseline', count(*) from m where is_reference union all select 'uploaded', count(*) from m where not is_reference
 union all select '7', count(*) from m where dataset_id = 7 union all select 'with_reference', count(*) from w where (owner = '2-HIGH' or is_reference) and not is_archived""")
def scopes(spark, sf_dir):
    rows = _owned(spark, sf_dir)
    each = [filters.in_scope(rows, "2-HIGH", s).select(F.lit(s).alias("scope")) for s in ("all", "baseline", "uploaded")] + [filters.in_scope(rows, "2-HIGH", 7).select(F.lit("7").alias("scope")), filters.with_reference(rows, "2-HIGH").select(F.lit("with_reference").alias("scope"))]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.groupBy("scope").agg(F.count("*").alias("n"))


# schema


@query("select p_partkey, case when regexp_matches(lower(trim(p_name)), 'produc|\\bprod\\.?\\b|output') then 1 else 0 end produced, lower(trim(p_name)) = '' as blank from part")
def column_map(spark, sf_dir):
    heads = binding.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("header"))
    found = schema.column_map(heads.select("header").distinct())
    return heads.join(found, "header").select("p_partkey", F.when((F.col("concept") == "production") & (F.col("confidence") == 0.85), 1).otherwise(0).alias("produced"), (F.lower(F.trim("header")) == "").alias("blank"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as maps, made from orders: a cell, its original, and for some the value before a correction."""
    o, k = binding.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    pair = lambda n, c: F.struct(F.lit(n).alias("key"), c.cast("string").alias("value"))
    entries = F.array(pair("production", F.floor("o_totalprice")), pair("production_original", F.concat(F.floor("o_totalprice").cast("string"), F.lit(" MT"))), pair("mine", F.col("o_clerk") if "o_clerk" in o.columns else F.col("o_orderpriority")), F.when(k % 3 == 0, pair("production_original_before_apply", F.lit("x"))))
    return o.select(k.alias("record_id"), k.alias("row_index"), F.map_from_entries(F.array_compact(entries)).alias("data"))


@query("select 'production' field, 'numeric' as type union all select 'mine', 'categorical'")
def field_types(spark, sf_dir):
    return schema.fields(_maps(spark, sf_dir)).where("field not like '%before_apply'")


@query("""with d as (select o_orderkey record_id, cast(cast(floor(o_totalprice) as bigint) as varchar) p from orders) select record_id, p as "current", p || ' MT' original, case when record_id % 3 = 0 then 'x' end before_apply, record_id % 3 = 0 was_maintained from d""")
def record_detail(spark, sf_dir):
    return schema.detail(_maps(spark, sf_dir)).where("field = 'production'").drop("field")


@query("""select o_orderkey row_index, cast(cast(floor(o_totalprice) as bigint) as varchar) "Production", cast(null as varchar) "Target" from orders""")
def schema_fill(spark, sf_dir):
    return writers.csv_rows(_maps(spark, sf_dir), ["Production", "Target"])


@query(f"""with {O} select record_id % 50 dataset_id, count(distinct record_id % 5) as columns, bool_or(record_id % 5 in (0, 1, 4)) has_production, false has_target, bool_or(record_id % 5 = 2) has_dispatch, false has_financial_year from o group by 1""")
def dataset_listing(spark, sf_dir):
    return datasets.listing(binding.key_values(spark, sf_dir).select("dataset_id", F.col("label").alias("field")).distinct())


@query(f"""with {O} select record_id, case when record_id % 3 = 0 then financial_year when record_id % 5 = 1 then '1997-98' when record_id % 2 = 0 then '2001-02' end fy from o""")
def record_years(spark, sf_dir):
    kv, k = binding.key_values(spark, sf_dir), F.col("record_id")
    rows = kv.withColumns({"year": F.lit(None).cast("string"), "label": F.when(k % 5 == 1, " Period ").otherwise(F.col("label")), "value": F.when(k % 5 == 1, "FY 1997/98").otherwise(F.col("value")), "title": F.when(k % 2 == 0, "Report 2001-02"), "filename": F.when(k % 2 == 1, F.lit("a.pdf")).otherwise("r_2001-02.pdf")})
    return datasets.record_years(rows).select("record_id", "fy")


@query("""with c as (select o_orderkey record_id, case o_orderkey % 4 when 0 then cast(cast(floor(o_totalprice) as bigint) as varchar) || ' MT' when 1 then 'n/a' when 2 then '-' || cast(o_orderkey as varchar) || 't x' end v from orders) select record_id, try_cast(nullif(regexp_replace(split_part(v, ' ', 1), '[^0-9.-]', '', 'g'), '') as double) number from c""")
def leading_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.when(k % 4 == 0, F.concat(F.floor("o_totalprice").cast("string"), F.lit(" MT"))).when(k % 4 == 1, "n/a").when(k % 4 == 2, F.concat(F.lit("-"), k.cast("string"), F.lit("t x")))
    return binding.table(spark, sf_dir, "orders").select(k.alias("record_id"), scalars.leading_number(v).alias("number"))


# quality and review


@query("""with f as (select l_orderkey k, bool_or(l_quantity < 2) e, bool_or(l_quantity >= 2 and l_quantity < 4) w from lineitem where l_linestatus = 'O' group by 1),
 g as (select o_totalprice < 1000 or o_orderkey % 10 = 0 or coalesce(e, false) is_error, (o_orderkey % 10 = 1) or coalesce(w, false) is_warning from orders left join f on k = o_orderkey)
 select is_error, is_warning, count(*) n from g group by 1, 2""")
def quality_flags(spark, sf_dir):
    k, q = F.col("o_orderkey"), F.col("l_quantity")
    own = F.when(k % 10 == 0, F.array(F.struct(F.lit("ERROR").alias("severity")))).when(k % 10 == 1, F.array(F.struct(F.lit("WARNING").alias("severity")))).otherwise(F.array().cast("array<struct<severity:string>>"))
    rows = binding.table(spark, sf_dir, "orders").select(k.alias("record_id"), (F.col("o_totalprice") >= 1000).alias("is_valid"), own.alias("validation_errors"))
    found = binding.table(spark, sf_dir, "lineitem").where("l_quantity < 4").select(F.col("l_orderkey").alias("record_id"), F.when(q < 2, "ERROR").otherwise("WARNING").alias("severity"), F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"))
    return quality.flagged(rows, found).groupBy("is_error", "is_warning").agg(F.count("*").alias("n"))


@query("""with t as (select l_orderkey k, bool_or(l_quantity < 3) e from lineitem group by 1) select cast(k as varchar) source_ref, case when e then 'needs_review' else 'indexed' end status from t""")
def document_statuses(spark, sf_dir):
    found = binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_ref"), F.when(F.col("l_quantity") < 3, "ERROR").otherwise("INFO").alias("severity"))
    return quality.document_status(found)


@query("select count(*) findings, count(*) filter (where l_quantity < 3) errors, count(*) filter (where l_quantity >= 3 and l_quantity < 5) warnings from lineitem")
def finding_counters(spark, sf_dir):
    q = F.col("l_quantity")
    return quality.counters(binding.table(spark, sf_dir, "lineitem").select(F.when(q < 3, "ERROR").when(q < 5, "WARNING").otherwise("INFO").alias("severity")))


@query("""with s as (select o_orderkey id, case o_orderkey % 3 when 0 then 'pending' when 1 then 'approved' else 'applied' end st, case o_orderkey % 5 when 0 then 'approve' when 1 then 'reject' end d from orders)
 select case when d = 'approve' and st = 'pending' then 'approved' when d = 'reject' and st in ('pending', 'approved') then 'rejected' else st end status, count(*) n from s group by 1""")
def decided_suggestions(spark, sf_dir):
    k = F.col("o_orderkey")
    o = binding.table(spark, sf_dir, "orders")
    s = o.select(k.alias("suggestion_id"), F.when(k % 3 == 0, "pending").when(k % 3 == 1, "approved").otherwise("applied").alias("status"))
    d = o.where(k % 5 < 2).select(k.alias("suggestion_id"), F.when(k % 5 == 0, "approve").otherwise("reject").alias("decision"))
    return cleaning.summary(cleaning.decided(s, d))


@query(f"with {C} select field, count(*) n from c group by 1 having count(*) > 0 and field <> 'remarks'")
def new_fields(spark, sf_dir):
    cells = binding.cells(spark, sf_dir)
    new = compare.new_fields(cells.where("field = 'remarks'").select("field"), cells.select("field"))
    return cells.join(new, "field").groupBy("field").agg(F.count("*").alias("n"))


@query(f"""with {O} select 'production' metric, (select count(production) > 0 from o where financial_year < '1995-00') in_past, (select count(production) > 0 from o where financial_year >= '1995-00') in_current
 union all select 'dispatch', (select count(dispatch) > 0 from o where financial_year < '1995-00'), (select count(dispatch) > 0 from o where financial_year >= '1995-00')""")
def comparison_coverage(spark, sf_dir):
    r = binding.order_records(spark, sf_dir)
    return compare.coverage(r.where("financial_year < '1995-00'"), r.where("financial_year >= '1995-00'"), ["production", "dispatch"])


@query(f"""with {O}, y as (select min(financial_year) f from o) select 'past' side, count(*) n from o, y where financial_year = f union all select 'current', count(*) from o, y where financial_year > f""")
def source_split(spark, sf_dir):
    past, current = compare.split_sources(binding.order_records(spark, sf_dir).withColumn("is_reference", F.lit(False)))
    return past.select(F.lit("past").alias("side")).unionByName(current.select(F.lit("current").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


# documents, jobs and reports


_STATES = "case o_orderkey % 4 when 0 then 'failed' when 1 then 'indexed' when 2 then 'processing' else 'uploaded' end"


@query(f"""with d as (select o_orderkey k, {_STATES} st from orders), r as (select *, k % 3 = 0 and st in ('failed', 'uploaded') again from d)
 select 'document' kind, case when again then 'queued' else st end status, count(*) n from r group by 1, 2
 union all select 'job', case when again then 'failed' else 'running' end, count(*) from r group by 1, 2 union all select 'job', 'pending', count(*) from r where again group by 1, 2""")
def document_retries(spark, sf_dir):
    k = F.col("o_orderkey")
    o = binding.table(spark, sf_dir, "orders")
    docs = o.select(k.alias("document_id"), F.expr(_STATES).alias("status"))
    after, jobs = lifecycle.retried(docs, o.select(k.alias("document_id"), F.lit("running").alias("status")), o.where(k % 3 == 0).select(k.alias("document_id")))
    both = after.select(F.lit("document").alias("kind"), "status").unionByName(jobs.select(F.lit("job").alias("kind"), "status"))
    return both.groupBy("kind", "status").agg(F.count("*").alias("n"))


@query(f"""select {_STATES} status, count(*) n from orders where o_orderkey % 4 = 1 and o_orderkey % 11 <> 0 and o_orderpriority = '2-HIGH' group by 1""")
def documents_to_index(spark, sf_dir):
    docs = _owned(spark, sf_dir).withColumn("status", F.expr(_STATES.replace("o_orderkey", "record_id")))
    return lifecycle.to_index(docs, "2-HIGH").groupBy("status").agg(F.count("*").alias("n"))


@query("""with f as (select l_orderkey k, count(*) c, min(l_linenumber) lo from lineitem where l_linenumber <= 3 group by 1), p as (select distinct l_orderkey k from lineitem where l_quantity > 40)
 select o_orderkey document_id, cast(o_orderkey % 3 as int) tables_count, p.k is not null has_provenance, cast(least(2, coalesce(c, 0)) as int) shown, f.lo first_finding from orders left join f on f.k = o_orderkey left join p on p.k = o_orderkey where o_orderkey % 11 <> 0""")
def extraction_details(spark, sf_dir):
    k = F.col("o_orderkey")
    o = binding.table(spark, sf_dir, "orders")
    docs = o.select(k.alias("document_id"), (k % 11 == 0).alias("is_archived"))
    made = o.select(k.alias("document_id"), F.expr("slice(array('a', 'b', 'c'), 1, cast(o_orderkey % 3 as int))").alias("tables"))
    li = binding.table(spark, sf_dir, "lineitem")
    found = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("finding_id"), F.lit("duplicate").alias("issue_type"), F.lit("WARNING").alias("severity"))
    out = lifecycle.extraction_detail(docs, made, found, li.where("l_quantity > 40").select(F.col("l_orderkey").alias("document_id")), most=2)
    return out.select("document_id", "tables_count", "has_provenance", F.coalesce(F.size("findings"), F.lit(0)).alias("shown"), F.try_element_at("findings", F.lit(1))["finding_id"].alias("first_finding"))


@query("""with r as (select o_orderkey k, case o_orderkey % 4 when 0 then 'GENERATED' when 1 then 'VERIFIED' when 2 then 'APPROVED' else 'FAILED' end st, case o_orderkey % 3 when 0 then 'APPROVED' when 1 then 'EXPORTED' end mv from orders)
 select case when (st = 'GENERATED' and mv = 'APPROVED') or (st = 'VERIFIED' and mv in ('APPROVED', 'EXPORTED')) or (st = 'APPROVED' and mv = 'EXPORTED') then mv else st end status, count(*) n from r group by 1""")
def report_moves(spark, sf_dir):
    k = F.col("o_orderkey")
    o = binding.table(spark, sf_dir, "orders")
    r = o.select(k.alias("report_id"), F.when(k % 4 == 0, "GENERATED").when(k % 4 == 1, "VERIFIED").when(k % 4 == 2, "APPROVED").otherwise("FAILED").alias("status"))
    return reports.moved(r, o.where(k % 3 < 2).select(k.alias("report_id"), F.when(k % 3 == 0, "APPROVED").otherwise("EXPORTED").alias("to"))).groupBy("status").agg(F.count("*").alias("n"))


@query("with f as (select o_orderkey k from orders order by 1 limit 50) select l_orderkey record_id, l_linenumber from lineitem semi join f on k = l_orderkey")
def report_provenance(spark, sf_dir):
    o = binding.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").alias("row_index"))
    return reports.provenance_of(o, binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), "l_linenumber"))


@query("select count(*) total, count(*) filter (where contains(lower(p_name), 'coal') or contains(lower(p_name), 'lignite')) coal_lignite from part")
def theme_summary(spark, sf_dir):
    return catalogue.theme_summary(binding.table(spark, sf_dir, "part").select(F.col("p_name").alias("theme")))


@query("select distinct p_name theme from part where p_name not in ('', 'null') order by 1 limit 30")
def first_themes(spark, sf_dir):
    return catalogue.first_themes(binding.table(spark, sf_dir, "part").select(F.col("p_name").alias("theme")))


@query("select event_id, event_type from events where user_id = 1 order by ts desc, event_id limit 50")
def query_history(spark, sf_dir):
    e = binding.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("owner"), F.struct(F.col("ts"), (-F.col("event_id")).alias("i")).alias("created_at"))
    return datasets.history(e, 1).select("event_id", "event_type")


# answers


@query("""with p as (select l_orderkey question_id, cast(l_linenumber as int) r, l_returnflag || l_linestatus s from lineitem), g as (select question_id, s source_ref, min(r) rank from p group by 1, 2)
 select *, count(*) over (partition by question_id) n_sources from g""")
def cited_sources(spark, sf_dir):
    found = binding.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").cast("int").alias("rank")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("s"))
    return answers.citations(found.select("question_id", "rank", F.explode("s").alias("source_ref")))


@query("""with d as (select doc_id, nullif(regexp_extract(text, '([A-Z][a-z]+) ', 1), '') first_name, nullif(regexp_extract(text, '([0-9]{3,})', 1), '') number from documents),
 x as (select doc_id, unnest(['name', 'number']) field, unnest([first_name, number]) t, unnest([case when doc_id % 2 = 0 then 'table' end, case when doc_id % 3 = 0 then 'table' end]) s from d)
 select doc_id, field, case when field = 'name' then coalesce(t, s) else coalesce(s, t) end as "value", case when (field = 'name' and t is not null) or (field <> 'name' and s is null) then 'text' else 'table' end origin from x where t is not null or s is not null""")
def fields_by_source(spark, sf_dir):
    d = binding.table(spark, sf_dir, "documents")
    chunks = d.select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    said = answers.fields_in_text(chunks, {"name": "([A-Z][a-z]+) ", "number": "([0-9]{3,})"})
    pairs = F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("name")), F.when(F.col("doc_id") % 3 == 0, F.lit("number")))
    table = d.select("doc_id", F.explode(F.array_compact(pairs)).alias("field"), F.lit("table").alias("value"))
    return answers.resolved_fields(table, said, ["name"])


@query(f"""with {O}, q as (select r_regionkey question_id, r_name subsidiary from region) select question_id, q.subsidiary, arg_min(production, record_id) as "value" from q join o on o.subsidiary = q.subsidiary where record_id % 7 = 0 group by 1, 2""")
def organization_answers(spark, sf_dir):
    none = F.lit(None).cast("string")
    q = binding.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("question_id"), F.col("r_name").alias("subsidiary"), none.alias("year"), F.lit("production").alias("metric"), none.alias("aggregation"))
    r = binding.order_records(spark, sf_dir).withColumn("is_reference", F.col("record_id") % 7 == 0)
    return answers.reference_answers(q, r).select("question_id", "subsidiary", "value")


_LINE_CELLS = """with r0 as (select l_orderkey, l_linenumber, [cast(l_linenumber as varchar), case when l_linenumber = 3 then ' ' else ' ' || cast(cast(l_quantity as int) as varchar) end, l_returnflag]
  || case when l_linenumber > 4 then ['', l_linestatus] else [] end cells from lineitem),
 r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, cells) - 1 n from r0),
 i as (select *, list_filter(list_transform(range(1, len(cells) + 1), lambda k: case when trim(cells[k]) <> '' then coalesce(['Line number', 'Quantity', 'Flag'][k], 'Col' || (k - 1)) || ': ' || trim(cells[k]) end), lambda x: x is not null) items from r),
 c as (select l_orderkey, n // 5 chunk_index, min(n) row_start, max(n) row_end, string_agg('Row ' || n || ': ' || array_to_string(items, ' | '), chr(10) order by n) body from i where len(items) > 0 group by 1, 2)"""


@query(f"""{_LINE_CELLS} select cast(l_orderkey as varchar) source_ref, cast(chunk_index as int) chunk_index, cast(row_start as int) row_start, cast(row_end as int) row_end,
 'Table ' || l_orderkey || case when l_orderkey % 2 = 0 then ' (Sheet: S' || l_orderkey % 4 || ')' else '' end || case when l_orderkey % 3 = 0 then ' [Section: Lines]' else '' end || ': Columns: Line number, Quantity, Flag' || chr(10) || body content from c""")
def table_chunks(spark, sf_dir):
    """Line items as the tables of orders: blank cells, cells beyond the headers, sheets and sections."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    cells = F.concat(F.array(n.cast("string"), F.when(n == 3, " ").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"))), F.col("l_returnflag")), F.when(n > 4, F.array(F.lit(""), F.col("l_linestatus"))).otherwise(F.array().cast("array<string>")))
    t = binding.table(spark, sf_dir, "lineitem").groupBy(k).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), cells.alias("cells")))).alias("rows"))
    t = t.select(k.cast("string").alias("source_ref"), F.transform("rows", lambda r: r["cells"]).alias("rows"), F.array(*map(F.lit, ("Line number", " Quantity", "Flag"))).alias("headers"),
                 F.when(k % 2 == 0, F.concat(F.lit("S"), (k % 4).cast("string"))).alias("sheet_name"), F.when(k % 3 == 0, "Lines").alias("section_heading"))
    return retrieval.chunk_tables(t).select("source_ref", "chunk_index", "row_start", "row_end", "content")


# metadata of documents, and keys in the order in which they are seen


@query("""with o as (select o_orderkey k from orders), m as (
 select k, 'financial_year' field, '2004-05' as "value", 'text' origin from o where k % 6 = 0 union all select k, 'mine', 'Gevra ' || k, 'text' from o where k % 6 = 0
 union all select k, 'organization', 'SECL', 'text' from o where k % 6 = 0 union all select k, 'location', 'Korba', 'text' from o where k % 6 = 0
 union all select k, 'financial_year', '2019-20', 'text' from o where k % 6 = 1 union all select k, 'organization', 'coal india limited', 'text' from o where k % 6 = 1
 union all select k, 'mine', 'Given ' || k, 'given' from o where k % 6 = 2 union all select k, 'location', 'Odisha', 'given' from o where k % 6 = 2
 union all select k, 'financial_year', '2020-21', 'table' from o where k % 6 = 3 union all select k, 'mine', 'Later ' || k, 'table' from o where k % 6 = 3
 union all select k, 'organization', 'Subsidiary', 'header' from o where k % 6 = 4) select k document_id, field, "value", origin from m""")
def document_metadata(spark, sf_dir):
    """Documents, one an order, that say their year, mine, organization and location in different places."""
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 6
    table = "array<struct<headers:array<string>,rows:array<array<string>>>>"
    lit = lambda *v: F.array(*[F.lit(x) if isinstance(x, str) else x for x in v])
    tall = F.array(F.struct(lit(" Field", "Value").alias("headers"), F.array(lit("Mine Name", F.concat(F.lit("Table "), k)), lit("Reporting Year", "2020-21"), lit("mine name ", F.concat(F.lit("Later "), k)), lit("District", "")).alias("rows")))
    wide = F.array(F.struct(lit("S.No", "Subsidiary ", "MT").alias("headers"), F.array().cast("array<array<string>>").alias("rows")))
    said = F.concat(F.lit("Reporting Year: 2004-05\nMine Name: Gevra "), k, F.lit(", Korba\nOperator = SECL\nLocation: Korba"))
    d = binding.table(spark, sf_dir, "orders").select(
        k.alias("document_id"), F.concat(F.lit("Order "), k).alias("title"), F.lit("o.pdf").alias("filename"), F.when(kind == 0, said).when(kind == 1, "report of coal india limited for FY 2019-20").otherwise("plain text").alias("raw_text"),
        F.when(kind == 2, F.create_map(F.lit("mine_name"), F.concat(F.lit("Given "), k), F.lit("state"), F.lit("Odisha"), F.lit("source"), F.lit(""))).alias("given"), F.when(kind == 3, tall.cast(table)).when(kind == 4, wide.cast(table)).alias("tables"))
    return schema.document_metadata(d)


@query("""select * from (values ('h0', 1), ('h1', 2), ('h2', 3)) v(key, place) union all select 'late', 4 from (select 1 from orders where o_orderkey % 5 = 4 limit 1)""")
def keys_first_seen(spark, sf_dir):
    """Keys of orders' maps: three that each has, and one that later ones alone have."""
    k = F.col("o_orderkey")
    base = F.create_map(*[x for i in range(3) for x in (F.lit(f"h{i}"), k.cast("string"))])
    data = F.when(k % 5 == 4, F.map_concat(F.create_map(F.lit("late"), F.lit("x")), base)).otherwise(base)
    first = F.create_map(F.lit("h0"), F.lit(""), F.lit("h1"), F.lit(""), F.lit("h2"), F.lit(""))
    records = binding.table(spark, sf_dir, "orders").select(k.alias("row_index"), data.alias("data")).unionByName(spark.range(1).select((F.col("id") - 1).alias("row_index"), first.alias("data")))
    return schema.first_seen(records).select("key", F.col("place").cast("int").alias("place"))


# comparison, lists and reports in order

_HALVES = f"""p as (select upper(mine) mine, {S('production')} past from o where not is_error and financial_year < '1995-00' group by 1), n as (select upper(mine) mine, {S('production')} "current" from o where not is_error and financial_year >= '1995-00' group by 1),
 a as (select mine, past, "current", case when past > 0 then round(("current" - past) / past * 100, 2) when past = 0 and "current" > 0 then 100.0 when past = 0 then 0.0 end pct from p full join n using (mine))"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = binding.order_records(spark, sf_dir)
    return compare.compare_groups(r.where("financial_year < '1995-00'"), r.where("financial_year >= '1995-00'"), "mine", "production")


@query(f"""with {O}, {_HALVES}, m as (select mine, case when "current" > past then 'improved' when "current" < past then 'declined' end status, pct from a)
 select mine, status, row_number() over (partition by status order by coalesce(pct, 0) desc, mine) place from m where status is not null""")
def comparison_movers(spark, sf_dir):
    return compare.movers(_compared(spark, sf_dir)).select("mine", "status", F.col("place").cast("long").alias("place"))


@query(f"""with {O}, {_HALVES} select mine, past, "current", row_number() over (order by mine) place from a where past is not null and "current" is not null order by mine limit 6""")
def comparison_chart(spark, sf_dir):
    return compare.chart(_compared(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"""with {B}, g as (select financial_year period, {Z('production')} production, {S('target')} t, {S('dispatch')} d from v group by 1)
 select period, production, case when t > 0 then t end target, case when d > 0 then d end dispatch, case when lag(production) over w > 0 then round((production - lag(production) over w) / lag(production) over w * 100, 1) end growth_pct from g window w as (order by period)""")
def report_production_years(spark, sf_dir):
    return reports.report("production_years", binding.records(spark, sf_dir))


@query("""with f as (select l_orderkey * 10 + l_linenumber id, case when l_quantity < 10 then 'ERROR' when l_quantity < 25 then 'INFO' else 'WARNING' end severity, l_returnflag issue_type from lineitem where l_linestatus = 'O')
 select severity, issue_type, count(*) n, row_number() over (order by severity desc, issue_type) place from f group by 1, 2""")
def findings_in_order(spark, sf_dir):
    q = F.col("l_quantity")
    f = binding.table(spark, sf_dir, "lineitem").select(F.when(q < 10, "ERROR").when(q < 25, "INFO").otherwise("WARNING").alias("severity"), F.col("l_returnflag").alias("issue_type"), F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("status"))
    counts = f.groupBy("severity", "issue_type", "status").agg(F.count("*").alias("n"))
    listed = datasets.findings_in_order(counts, status="open").select("severity", "issue_type", "n")
    return listed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("severity"), "issue_type")).cast("long"))  # a row a kind


@query(f"""with {_OWNED} select record_id document_id from w where owner = '2-HIGH' and not is_archived and (contains(lower(owner || record_id), '12') or contains(lower('f' || record_id || '.pdf'), '12')) order by o_totalprice desc, record_id limit 30""")
def document_list(spark, sf_dir):
    d = _owned(spark, sf_dir).select(F.col("record_id").alias("document_id"), "owner", "is_archived", F.lit("indexed").alias("status"), F.concat("owner", F.col("record_id").cast("string")).alias("title"), F.concat(F.lit("f"), F.col("record_id").cast("string"), F.lit(".pdf")).alias("filename"), F.col("o_totalprice").alias("created_at"))
    return datasets.document_list(d, "2-HIGH", "indexed", " 12 ", "-nothing").select("document_id").limit(30)


@query(f"""with {O} select record_id, case when record_id % 5 in (0, 1, 4) then cast(floor(production) as double) end as "value" from o""")
def metric_reader(spark, sf_dir):
    kv = binding.key_values(spark, sf_dir)
    return kv.select("record_id", aggregates.label_value(F.col("label"), F.col("value"), "production").alias("value"))
