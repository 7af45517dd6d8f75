"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import scalars, vocab
from strataframe.operators import aggregates, answers, catalogue, cleaning, compare, datasets, filters, paging, quality, reports, retrieval, schema, trends
from strataframe.plans import binding
from strataframe.streaming.ingest import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PLACES = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
_START = "(case when month(o_orderdate) >= 4 then year(o_orderdate) else year(o_orderdate) - 1 end)"
_FY = f"cast({_START} as varchar) || '-' || lpad(cast(({_START} + 1) % 100 as varchar), 2, '0')"
#: The bindings as SQL: b has line items, o has orders, m has suppliers, c has cells.
B = f"""b as (select l_orderkey * 10 + l_linenumber record_id, l_orderkey row_index, r_name subsidiary, n_name mine, c_mktsegment coalfield, r_name state, l_returnflag grade,
  l_linestatus coal_type, l_linestatus status, {_FY} financial_year, l_quantity production, l_quantity * (1 + l_discount) target,
  case when l_linestatus = 'F' then l_quantity end dispatch, (l_returnflag = 'R' and l_quantity < 2) is_error, l_quantity < 3 is_warning
  from lineitem join {_PLACES} on l_orderkey = o_orderkey), v as (select * from b where not is_error)"""
O = f"""o as (select o_orderkey record_id, r_name subsidiary, n_name mine, c_mktsegment coalfield, r_name state, o_orderpriority grade, o_orderstatus status, {_FY} financial_year,
  o_totalprice production, o_totalprice * 0.5 target, case when o_orderstatus = 'F' then o_totalprice end dispatch, o_totalprice < 1000 is_error, o_totalprice < 5000 is_warning
  from {_PLACES}), ov as (select * from o where not is_error)"""  # noqa: E741
B = B.replace(f"lineitem join {_PLACES} on l_orderkey = o_orderkey", f"lineitem join {_PLACES.replace('orders join customer', 'orders on l_orderkey = o_orderkey join customer', 1)}")
M = "m as (select s_suppkey mine_id, s_name mine_name, n_name state, r_name subsidiary, n_name coalfield, s_acctbal production from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
C = """c as (select o_orderkey record_id, case o_orderkey % 3 when 0 then 'production' when 1 then 'remarks' else 'latitude' end field, case o_orderkey % 8
  when 0 then '  ' || o_orderpriority || ' '
  when 1 then cast(p // 1000 as varchar) || ',' || lpad(cast(p % 1000 as varchar), 3, '0')
  when 2 then 'FY' || cast(year(o_orderdate) as varchar) || '-' || lpad(cast((year(o_orderdate) + 1) % 100 as varchar), 2, '0')
  when 3 then strftime(o_orderdate, '%d/%m/%Y')
  when 4 then cast(p % 100 as varchar) || ' %'
  when 5 then cast(p as varchar) || ' mt'
  when 6 then '+' || cast(p as varchar)
  else '-' || cast(p as varchar) end value from (select *, cast(trunc(o_totalprice) as bigint) p from orders))"""


def S(c: str) -> str:
    """Sum to 2 places, by decimals."""
    return f"cast(round(sum(cast({c} as decimal(28,8))), 2) as double)"


def Z(c: str) -> str:
    return f"coalesce({S(c)}, 0.0)"


def ACH(a: str, b: str) -> str:
    return f"case when {b} > 0 then round({a} / {b} * 100, 1) end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# aggregates


@query(f"with {B} select {S('production')} s, round(cast(sum(cast(production as decimal(28,8))) as double) / count(production), 2) a, min(production) lo, max(production) hi, cast(count(*) as double) n from v")
def agg_global(spark, sf_dir):
    r = filters.filter_records(binding.records(spark, sf_dir))
    m = aggregates.measure
    return r.agg(m("sum", "production").alias("s"), m("avg", "production").alias("a"), m("min", "production").alias("lo"), m("max", "production").alias("hi"), m("count", "production").alias("n"))


@query(f"with {B}, g as (select subsidiary grp, {S('production')} value, count(*) record_count from v group by 1) select *, count(*) over () total_groups from g")
def grouped_sum_by_region(spark, sf_dir):
    return aggregates.grouped(filters.filter_records(binding.records(spark, sf_dir)), "subsidiary", "sum", "production")


@query(f"with {B}, g as (select mine grp, round(cast(sum(cast(target as decimal(28,8))) as double) / count(target), 2) value, count(*) record_count from v group by 1), t as (select *, count(*) over () total_groups from g) select * from t order by value desc, grp limit 7")
def grouped_avg_top(spark, sf_dir):
    return aggregates.grouped(filters.filter_records(binding.records(spark, sf_dir)), "mine", "avg", "target", limit=7)


@query(f"with {B}, g as (select financial_year grp, cast(count(*) as double) value, count(*) record_count from v group by 1), t as (select *, count(*) over () total_groups from g) select * from t order by grp limit 4")
def grouped_count_by_year(spark, sf_dir):
    return aggregates.grouped(filters.filter_records(binding.records(spark, sf_dir)), "financial_year", "count", "production", sort_by="group", descending=False, limit=4)


@query(f"""with {B}, k as (select {S('production')} total_production, {S('target')} total_target, {S('dispatch')} total_dispatch, count(distinct mine) mine_count, count(distinct subsidiary) subsidiary_count, count(*) record_count from v)
 select k.*, (select count(*) from b where is_error) error_count, (select count(*) from b where is_warning) warning_count, {ACH('total_production', 'total_target')} achievement_pct from k""")
def kpi_bundle(spark, sf_dir):
    return aggregates.indicators(binding.records(spark, sf_dir))


@query(f"""with {B}, g as (select financial_year fy, cast(sum(cast(production as decimal(28,8))) as double) v from v group by 1), r as (select *, row_number() over (order by fy desc) r from g)
 select 'production' metric, p.fy previous_fy, c.fy current_fy, p.v previous, c.v "current", round((c.v - p.v) / p.v * 100, 4) growth_pct from r c join r p on c.r = 1 and p.r = 2""")
def kpi_latest_growth(spark, sf_dir):
    return aggregates.latest_growth(binding.records(spark, sf_dir))


@query(f"""with {B}, t as (select mine grp, {S('production')} value, count(*) record_count from v group by 1 order by value desc, grp limit 8)
 select *, round(value / cast(sum(cast(value as decimal(28,8))) over () as double) * 100, 1) share_pct from t""")
def breakdown_topn_share(spark, sf_dir):
    return aggregates.breakdown(binding.records(spark, sf_dir), "mine", "production", 8)


@query(f"with {B} select distinct field, value from (select unnest(['subsidiary', 'mine', 'grade', 'status', 'financial_year']) field, unnest([subsidiary, mine, grade, status, financial_year]) value from b)")
def distinct_options(spark, sf_dir):
    return aggregates.options(binding.records(spark, sf_dir), ["subsidiary", "mine", "grade", "status", "financial_year"])


@query(f"with {O} select record_id, mine, production from ov order by production desc, record_id limit 1")
def metric_winner(spark, sf_dir):
    return aggregates.best_record(filters.filter_records(binding.order_records(spark, sf_dir)), "production", "max").select("record_id", "mine", "production")


@query(f"""with {O}, g as (select mine, record_id, row_number() over (partition by mine order by record_id) r from ov)
 select mine, string_agg(cast(record_id as varchar), ',' order by record_id) ids from g where r <= 50 group by 1""")
def first_ids_by_group(spark, sf_dir):
    return aggregates.first_ids(filters.filter_records(binding.order_records(spark, sf_dir)), "mine", 50)


# trends

_TREND = f"""g as (select {{by}} financial_year period, {Z('production')} value, count(production) record_count, {S('target')} target, {S('dispatch')} dispatch from v group by all)"""
_TREND_OUT = "value, record_count, case when target > 0 then target end target, case when dispatch > 0 then dispatch end dispatch, case when target > 0 then round(value / target * 100, 1) end achievement_pct"


@query(f"with {B}, {_TREND.format(by='')} select period, {_TREND_OUT}, case when lag(value) over w > 0 then round((value - lag(value) over w) / lag(value) over w * 100, 1) end growth_pct from g window w as (order by period)")
def trend_fy_growth(spark, sf_dir):
    return trends.trend(binding.records(spark, sf_dir))


@query(f"with {B}, {_TREND.format(by='subsidiary,')} select subsidiary, period, {_TREND_OUT}, case when lag(value) over w > 0 then round((value - lag(value) over w) / lag(value) over w * 100, 1) end growth_pct from g window w as (partition by subsidiary order by period)")
def trend_by_subsidiary(spark, sf_dir):
    return trends.trend(binding.records(spark, sf_dir), by=["subsidiary"])


@query(f"""with {B}, {_TREND.format(by='')}, s as (select count(*) periods, arg_min(value, period) first_value, arg_max(value, period) last_value, min(period) first_period, max(period) last_period from g)
 select *, periods >= 2 has_sufficient_history, case when periods >= 2 and first_value > 0 then round((last_value - first_value) / first_value * 100, 2) end overall_growth_pct from s""")
def trend_summary(spark, sf_dir):
    return trends.trend_summary(trends.trend(binding.records(spark, sf_dir)))


# filters

_COUNT = f"select count(*) n, {S('production')} total"


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), aggregates.rounded_sum(F.col("production")).alias("total"))


@query(f"with {B} {_COUNT} from v where lower(subsidiary) = 'east' or list_contains(string_split_regex(lower(subsidiary), '[\\s\\(\\)\\/,\\.-]+'), 'east')")
def filter_token(spark, sf_dir):
    return _count(filters.filter_records(binding.records(spark, sf_dir), {"subsidiary": "EAST"}))


@query(f"with {B} {_COUNT} from v where contains(lower(mine), 'an')")
def filter_contains(spark, sf_dir):
    return _count(filters.filter_records(binding.records(spark, sf_dir), {"mine": "An", "grade": "all", "unknown": "x"}))


@query(f"with {B} {_COUNT} from v where financial_year = '1995-96'")
def filter_fy(spark, sf_dir):
    return _count(filters.filter_records(binding.records(spark, sf_dir), {"financial_year": "FY 1995/96"}))


@query(f"with {O} {_COUNT} from ov where contains(lower(concat_ws(' ', subsidiary, mine, status)), 'a f')")
def global_search(spark, sf_dir):
    r = binding.order_records(spark, sf_dir).select("subsidiary", "mine", "status", "production", "is_error")
    return _count(r.where(~F.col("is_error")).where(filters.search(["subsidiary", "mine", "status"], "a F")))


@query(f"with {B} select count(*) filter (where is_error) errors, count(*) filter (where is_warning) warnings, count(*) filter (where not is_error and not is_warning) clean from b")
def quality_sets(spark, sf_dir):
    return filters.quality_counts(binding.records(spark, sf_dir))


@query("select o_orderstatus, count(*) n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1")
def semi_sheet(spark, sf_dir):
    o = binding.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "record_id")
    sheets = binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("sheet_name"))
    return filters.on_sheet(o, sheets, " r ").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select o_orderstatus, count(*) n from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity < 3) group by 1")
def anti_errors(spark, sf_dir):
    o = binding.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "record_id")
    bad = binding.table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_orderkey").alias("record_id"))
    return filters.without_errors(o, bad).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# pages


@query(f"with {O} select record_id, mine, grade, production from o order by production desc, record_id limit 25 offset 50")
def explorer_page(spark, sf_dir):
    return paging.page(binding.order_records(spark, sf_dir), "production", "numeric", True, 3, 25).select("record_id", "mine", "grade", "production")


@query(f"with {O} select record_id, mine, dispatch from o order by dispatch desc nulls first, record_id limit 10 offset 20")
def explorer_nulls_first(spark, sf_dir):
    return paging.page(binding.order_records(spark, sf_dir), "dispatch", "numeric", True, 3, 10).select("record_id", "mine", "dispatch")


@query("select count(*) total, cast(ceil(count(*) / 40.0) as bigint) pages from orders")
def page_count(spark, sf_dir):
    return paging.page_count(binding.table(spark, sf_dir, "orders"), 40)


# comparison

_PAST, _NOW = "financial_year < '1995-00'", "financial_year >= '1995-00'"
_PCT = "case when past > 0 then round((\"current\" - past) / past * 100, 2) when past = 0 and \"current\" > 0 then 100.0 when past = 0 then 0.0 end"
_STATUS = "case when past is null then 'new' when \"current\" is null then 'missing' when \"current\" > past then 'improved' when \"current\" < past then 'declined' else 'unchanged' end"
_ALIGNED = f"past, \"current\", round(\"current\" - past, 2) difference, {_PCT} pct, {_STATUS} status"


@query(f"""with {B}, p as (select unnest(['production', 'target', 'dispatch']) metric, unnest([{S('production')}, {S('target')}, {S('dispatch')}]) past from v where {_PAST}),
 n as (select unnest(['production', 'target', 'dispatch']) metric, unnest([{S('production')}, {S('target')}, {S('dispatch')}]) "current" from v where {_NOW})
 select metric, {_ALIGNED} from p full join n using (metric)""")
def compare_metrics(spark, sf_dir):
    r = binding.records(spark, sf_dir)
    return compare.compare_metrics(r.where(_PAST), r.where(_NOW), ["production", "target", "dispatch"])


@query(f"""with {B}, p as (select upper(mine) mine, {S('production')} past from v where {_PAST} and grade = 'A' group by 1), n as (select upper(mine) mine, {S('production')} "current" from v where {_NOW} and grade = 'A' group by 1)
 select mine, {_ALIGNED} from p full join n using (mine)""")
def compare_groups(spark, sf_dir):
    r = binding.records(spark, sf_dir).where("grade = 'A'")
    return compare.compare_groups(r.where(_PAST), r.where(_NOW), "mine", "production")


@query(f"with {B} select {ACH(S('dispatch'), S('production'))} evacuation_pct from v")
def compare_evacuation(spark, sf_dir):
    return compare.evacuation(binding.records(spark, sf_dir))


# reports

_FIRST = "array_to_string(list_slice(list_sort(list_distinct(list({c}))), 1, {n}), ', ')"


@query(f"with {B}, g as (select upper(subsidiary) subsidiary, {Z('production')} production, {Z('target')} target, {Z('dispatch')} dispatch, count(distinct mine) mines from v group by 1) select *, {ACH('production', 'target')} achievement_pct, false is_fallback from g")
def report_production(spark, sf_dir):
    return reports.report("production", binding.records(spark, sf_dir))


@query(f"with {B} select mine, {Z('production')} production from v group by 1 order by 2 desc, 1 limit 10")
def report_top_mines(spark, sf_dir):
    return reports.report("top_mines", binding.records(spark, sf_dir))


@query(f"with {B} select coalfield, {_FIRST.format(c='state', n=100)} states, count(distinct mine) mines, {_FIRST.format(c='grade', n=4)} grades, {Z('production')} production from v group by 1")
def report_geological(spark, sf_dir):
    return reports.report("geological", binding.records(spark, sf_dir))


@query(f"with {B}, g as (select grade, {_FIRST.format(c='coal_type', n=100)} types, count(*) records, {Z('production')} production, false coking from v group by 1) select *, round(production / cast(sum(cast(production as decimal(28,8))) over () as double) * 100, 1) share_pct from g")
def report_grades(spark, sf_dir):
    return reports.report("grades", binding.records(spark, sf_dir))


@query(f"""with {O}, g as (select record_id, mine, production, target, coalesce(dispatch, 0.0) dispatch from ov order by production desc, record_id limit 12)
 select *, round(production - target, 2) variance, {ACH('production', 'target')} achievement_pct, {ACH('dispatch', 'production')} dispatch_pct, case when round(production - target, 2) >= 0 then 'surplus' else 'deficit' end standing from g""")
def report_mining_performance(spark, sf_dir):
    return reports.report("mining_performance", binding.order_records(spark, sf_dir))


@query(f"with {O} select mine area, arg_max(coalfield, record_id) coalfield, arg_max(state, record_id) state, count(*) records, {_FIRST.format(c='grade', n=3)} seams from ov group by 1 order by records desc, area limit 10")
def report_exploration(spark, sf_dir):
    return reports.report("exploration", binding.order_records(spark, sf_dir))


@query(f"with {B}, g as (select grade, {_FIRST.format(c='coal_type', n=100)} types, {_FIRST.format(c='coalfield', n=2)} coalfields, count(distinct mine) mines, {Z('production')} production from v group by 1) select *, round(production / cast(sum(cast(production as decimal(28,8))) over () as double) * 100, 1) share_pct from g")
def report_coal_seam(spark, sf_dir):
    return reports.report("coal_seam", binding.records(spark, sf_dir))


@query(f"with {B}, g as (select upper(subsidiary) subsidiary, {Z('target')} target, {Z('production')} production, {Z('dispatch')} dispatch from v where financial_year in ('1994-95', '1995-96') group by 1) select *, {ACH('production', 'target')} achievement_pct from g")
def report_parliamentary(spark, sf_dir):
    return reports.report("parliamentary", binding.records(spark, sf_dir), years=["1994-95", "1995-96"])


@query(f"with {B} select upper(subsidiary) subsidiary, count(distinct mine) mines, count(*) records, {Z('production')} production, {Z('dispatch')} dispatch from v group by 1")
def report_administrative(spark, sf_dir):
    return reports.report("administrative", binding.records(spark, sf_dir), organization="All")


@query(f"with {B} select upper(subsidiary) subsidiary, {_FIRST.format(c='coalfield', n=2)} coalfields, count(distinct mine) mines, {Z('production')} production, {Z('dispatch')} dispatch, {Z('target')} target from v group by 1")
def report_custom(spark, sf_dir):
    return reports.report("custom", binding.records(spark, sf_dir))


# scalar functions and validation


@query(f"""with {C} select record_id, try_cast(nullif(regexp_extract(replace(trim(value), ',', ''), '[-+]?\\d+(?:\\.\\d+)?(?:[eE][-+]?\\d+)?'), '') as double) number from c""")
def parse_numeric(spark, sf_dir):
    return binding.cells(spark, sf_dir).select("record_id", scalars.parse_numeric(F.col("value")).alias("number"))


@query(f"""with {C}, x as (select record_id, nullif(regexp_extract(value, '(?i)(?:fy|f\\.y\\.|financial\\s*year)?\\s*(\\d{{2,4}})[-/](\\d{{2,4}})', 1), '') a, nullif(regexp_extract(value, '(?i)(?:fy|f\\.y\\.|financial\\s*year)?\\s*(\\d{{2,4}})[-/](\\d{{2,4}})', 2), '') b from c)
 select record_id, case when length(a) = 2 then '20' || a else a end || '-' || right(b, 2) as "year" from x""")
def parse_financial_year(spark, sf_dir):
    return binding.cells(spark, sf_dir).select("record_id", scalars.normalize_financial_year(F.col("value")).alias("year"))


@query(f"with {C} select record_id, strftime(coalesce(try_strptime(trim(value), '%d/%m/%Y'), try_strptime(trim(value), '%d-%m-%Y'), try_strptime(trim(value), '%Y-%m-%d')), '%Y-%m-%d') as \"day\" from c")
def normalize_date(spark, sf_dir):
    return binding.cells(spark, sf_dir).select("record_id", scalars.normalize_date(F.col("value")).alias("day"))


_CONCEPT = "case " + " ".join("when regexp_matches(lower(trim({c})), '" + "|".join(f"(?:{p})" for p in ps) + f"') then '{c}'" for c, ps in vocab.CONCEPTS.items()) + " end"


@query(f"select p_partkey, {_CONCEPT.replace('{c}', 'p_name')} concept from part")
def detect_concepts(spark, sf_dir):
    return binding.table(spark, sf_dir, "part").select("p_partkey", scalars.concept(F.col("p_name")).alias("concept"))


_NUM = "try_cast(replace(regexp_extract(value, '[+-]?(?:\\d{1,3}(?:,\\d{2,3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?|\\.\\d+)(?:[eE][+-]?\\d+)?'), ',', '') as double)"
_AT = "try_cast(replace(trim(value), ',', '.') as double)"


@query(f"""with {C} select issue_type, severity, field_name, count(*) n, min(original_value) lowest from (
 select 'invalid_numeric' issue_type, 'ERROR' severity, field field_name, value original_value from c where field = 'production' and {_NUM} is null
 union all select 'suspicious_value', 'WARNING', field, value from c where field = 'production' and {_NUM} < 0
 union all select 'coordinate_error', 'WARNING', field, value from c where field = 'latitude' and {_AT} is null
 union all select 'coordinate_error', 'ERROR', field, value from c where field = 'latitude' and abs({_AT}) > 90) group by all""")
def validate_cells(spark, sf_dir):
    c = binding.cells(spark, sf_dir).withColumn("concept", scalars.concept(F.col("field")))
    found = c.select(F.inline(F.array_compact(F.array(quality.cell_issues(F.col("record_id"), F.col("field"), F.col("concept"), F.col("value"))))))
    return found.groupBy("issue_type", "severity", "field_name").agg(F.count("*").alias("n"), F.min("original_value").alias("lowest"))


@query("select l_orderkey, l_linenumber, count(*) - 1 repeats from lineitem group by 1, 2 having count(*) > 1")
def duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(binding.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""with t as (select l_orderkey k, count(*) n, count(distinct (l_linenumber, l_quantity)) u from lineitem group by 1)
 select issue_type, severity, n from (select 'missing_required' issue_type, 'INFO' severity, 3 * count(*) n from t union all select 'duplicate_record', 'WARNING', sum(n - u) from t union all select 'duplicate', 'WARNING', count(*) from t
 union all select 'suspicious_value', 'WARNING', count(*) from lineitem where 1 - l_quantity < 0) where n > 0""")
def validate_tables(spark, sf_dir):
    tables = _order_tables(spark, sf_dir)
    return quality.validate(tables).groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table an order, of text cells: its lines, quantities (below 0 but for the first), and a column named twice."""
    row = F.array(F.col("l_linenumber").cast("string"), F.concat((1 - F.col("l_quantity")).cast("string"), F.lit(" MT")), F.col("l_quantity").cast("string"))
    rows = binding.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("source_ref")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("source_ref", F.array(F.lit("Mine"), F.lit("Production (MT)"), F.lit("Mine")).alias("headers"), "rows")


@query("select cast(l_orderkey as varchar) source_ref, count(*) n, cast(sum(cast(1 - l_quantity as decimal(28,8))) as double) production, min(cast(l_quantity as varchar)) mine from lineitem group by 1")
def normalize_rows(spark, sf_dir):
    data = schema.normalized_rows(_order_tables(spark, sf_dir))
    value = F.col("data.production").try_cast("double")
    return data.groupBy("source_ref").agg(F.count("*").alias("n"), aggregates.exact_sum(value).alias("production"), F.min("data.mine").alias("mine"))


# cleaning

_FYN = "case when regexp_matches(s, '(?i)(?:fy|f\\.y\\.|financial\\s*year)?\\s*(\\d{2,4})[-/](\\d{2,4})') then (case when length(regexp_extract(s, '(\\d{2,4})[-/](\\d{2,4})', 1)) = 2 then '20' else '' end) || regexp_extract(s, '(\\d{2,4})[-/](\\d{2,4})', 1) || '-' || right(regexp_extract(s, '(\\d{2,4})[-/](\\d{2,4})', 2), 2) end"
_SUGGEST = f"""{C}, x as (select *, trim(value) s from c), g as (
 select record_id, field field_name, value original_value, trim(regexp_replace(value, '\\s+', ' ', 'g')) suggested_value, 'whitespace' issue_type from x where trim(regexp_replace(value, '\\s+', ' ', 'g')) <> value
 union all select record_id, field, value, replace(s, ',', ''), 'comma_number' from x where regexp_matches(s, '^[-+]?\\d{{1,3}}(?:,\\d{{2,3}})+(?:\\.\\d+)?$')
 union all select record_id, field, value, s[2:], 'numeric_format' from x where regexp_matches(s, '^\\+\\d+(?:\\.\\d+)?$')
 union all select record_id, field, value, regexp_extract(s, '^([-+]?\\d+(?:\\.\\d+)?)\\s+%$', 1) || '%', 'percentage' from x where regexp_matches(s, '^([-+]?\\d+(?:\\.\\d+)?)\\s+%$')
 union all select record_id, field, value, {_FYN}, 'financial_year' from x where {_FYN} <> s
 union all select record_id, field, value, strftime(try_strptime(s, '%d/%m/%Y'), '%Y-%m-%d'), 'date_format' from x where try_strptime(s, '%d/%m/%Y') is not null
 union all select record_id, field, value, regexp_replace(s, '(?i)\\bmt\\b', 'MT', 'g'), 'unit_normalization' from x where regexp_replace(s, '(?i)\\bmt\\b', 'MT', 'g') <> s)"""


@query(f"with {_SUGGEST} select * from g")
def suggestions(spark, sf_dir):
    return cleaning.suggestions(binding.cells(spark, sf_dir)).select("record_id", "field_name", "original_value", "suggested_value", "issue_type")


@query(f"""with {_SUGGEST}, r as (select *, row_number() over (partition by record_id order by case issue_type when 'whitespace' then 0 when 'comma_number' then 1 when 'numeric_format' then 2 when 'percentage' then 3 when 'financial_year' then 4 when 'date_format' then 5 else 6 end) r from g)
 select c.record_id, coalesce(suggested_value, value) value, case when suggested_value is not null then value end before_apply from c left join r on c.record_id = r.record_id and r.r = 1""")
def apply_suggestions(spark, sf_dir):
    cells = binding.cells(spark, sf_dir)
    found = cleaning.suggestions(cells).withColumn("suggestion_id", F.col("record_id") * 10 + F.col("rule")).withColumn("status", F.lit("approved"))
    return cleaning.apply_approved(cells, found)[0].select("record_id", "value", "before_apply")


@query(f"""with {_SUGGEST}, r as (select row_number() over (partition by record_id order by case issue_type when 'whitespace' then 0 when 'comma_number' then 1 when 'numeric_format' then 2 when 'percentage' then 3 when 'financial_year' then 4 when 'date_format' then 5 else 6 end) r from g)
 select case when r = 1 then 'applied' else 'failed' end status, count(*) n from r group by 1""")
def apply_statuses(spark, sf_dir):
    cells = binding.cells(spark, sf_dir)
    found = cleaning.suggestions(cells).withColumn("suggestion_id", F.col("record_id") * 10 + F.col("rule")).withColumn("status", F.lit("approved"))
    return cleaning.summary(cleaning.apply_approved(cells, found)[1])


# texts

_STOP = ", ".join(f"'{w}'" for w in sorted(set(vocab.TOPIC_STOP)))
_WORDS = f"""w as (select doc_id, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '(?i)\\bopen[- ]cast\\b', 'opencast', 'g'), '(?i)\\bnon[- ]coking\\b', 'non-coking', 'g')), '[a-zA-Z][a-zA-Z\\-]{{2,}}')) w from documents), k as (select * from w where w not in ({_STOP}))"""


@query(f"with {_WORDS}, g as (select w, count(*) n from k group by 1 having count(*) >= 2), t as (select * from g order by n desc, w limit 60) select upper(w) word, n, round(n / cast(max(n) over () as double), 3) weight from t")
def word_cloud(spark, sf_dir):
    return retrieval.word_cloud(binding.table(spark, sf_dir, "documents"))


_TOPICS = " union all ".join(f"select '{t}' topic, '{w}' w, {i} ord, {n} place" for i, (t, k) in enumerate(vocab.TOPICS.items()) for n, w in enumerate(k))


@query(f"""with {_WORDS}, f as (select w, count(*) n from k group by 1), tp as ({_TOPICS}), s as (select topic, count(f.w) matched, count(*) total, array_to_string(list_slice(list(tp.w order by n desc, place) filter (n is not null), 1, 5), ',') keywords from tp left join f on f.w = tp.w group by 1),
 q as (select *, matched / cast(total as double) sc from s where matched > 0)
 select topic, matched, round(sc, 4) score, cast(round_even(round(sc / cast(sum(cast(sc as decimal(18,12))) over () as double) * 100, 9), 0) as int) pct, keywords from q""")
def topic_distribution(spark, sf_dir):
    return retrieval.topic_distribution(binding.table(spark, sf_dir, "documents"))


@query(f"""with {_WORDS}, tp as ({_TOPICS}), n as (select topic, count(*) total, min(ord) ord from tp group by 1), h as (select doc_id, topic, count(distinct tp.w) hits from k join tp on k.w = tp.w group by 1, 2),
 b as (select doc_id, topic, row_number() over (partition by doc_id order by hits / cast(total as double) desc, ord) r from h join n using (topic))
 select coalesce(topic, '—') topic, count(*) n from documents d left join (select * from b where r = 1) x on d.doc_id = x.doc_id group by 1""")
def topic_documents(spark, sf_dir):
    return retrieval.dominant_topics(binding.table(spark, sf_dir, "documents")).groupBy("topic").agg(F.count("*").alias("n"))


#: Documents that speak of topics, by id: some words of one, of two, or of none.
_SAID = [" ".join(w for w in k if " " not in w) for k in vocab.TOPICS.values()]
_TOPICAL = f"""documents as (select doc_id, coalesce(text, '') || ' ' || coalesce(array_to_string(list_slice(string_split([{", ".join(f"'{x}'" for x in _SAID)}][doc_id % {len(_SAID) + 1}], ' '), 1, 1 + doc_id % 4), ' '), '') ||
 case when doc_id % 3 = 0 then ' ' || string_split([{", ".join(f"'{x}'" for x in _SAID)}][1 + doc_id % 2], ' ')[1] else '' end text from main.documents)"""


def _topical(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, said = F.col("doc_id"), F.array(*map(F.lit, _SAID))
    words = lambda at, n: F.coalesce(F.array_join(F.slice(F.split(F.get(said, at - 1), " "), 1, n), " "), F.lit(""))
    more = F.when(i % 3 == 0, F.concat(F.lit(" "), words((1 + i % 2).cast("int"), 1))).otherwise("")
    return binding.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), words((i % (len(_SAID) + 1)).cast("int"), (1 + i % 4).cast("int")), more).alias("text"))


@query(f"""with {_TOPICAL}, {_WORDS}, f as (select w, count(*) n from k group by 1), tp as ({_TOPICS}), s as (select topic, count(f.w) matched, count(*) total, array_to_string(list_slice(list(tp.w order by n desc, place) filter (n is not null), 1, 5), ',') keywords from tp left join f on f.w = tp.w group by 1),
 q as (select *, matched / cast(total as double) sc from s where matched > 0)
 select topic, matched, round(sc, 4) score, cast(round_even(round(sc / cast(sum(cast(sc as decimal(18,12))) over () as double) * 100, 9), 0) as int) pct, keywords from q""")
def topics_said(spark, sf_dir):
    return retrieval.topic_distribution(_topical(spark, sf_dir))


@query(f"""with {_TOPICAL}, l as (select doc_id, list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '(?i)\\bopen[- ]cast\\b', 'opencast', 'g'), '(?i)\\bnon[- ]coking\\b', 'non-coking', 'g')), '[a-zA-Z][a-zA-Z\\-]{{2,}}'), lambda x: x not in ({_STOP})) a from documents),
 z as (select doc_id, a[i] w, i p from (select doc_id, a, unnest(range(1, len(a) + 1)) i from l)),
 c as (select doc_id, w, count(*) n, min(p) p from z group by 1, 2), kw as (select doc_id, array_to_string(list_slice(list(w order by n desc, p), 1, 6), ',') keywords from c group by 1),
 tp as ({_TOPICS}), t as (select topic, count(*) total, min(ord) ord from tp group by 1), h as (select doc_id, topic, count(distinct tp.w) hits from c join tp on c.w = tp.w group by 1, 2),
 b as (select doc_id, topic, row_number() over (partition by doc_id order by hits / cast(total as double) desc, ord) r from h join t using (topic))
 select d.doc_id, coalesce(topic, '—') topic, coalesce(keywords, '') keywords from documents d left join (select * from b where r = 1) x on d.doc_id = x.doc_id left join kw on kw.doc_id = d.doc_id""")
def documents_by_topic(spark, sf_dir):
    return retrieval.dominant_topics(_topical(spark, sf_dir))


_QUESTION = "pathetic thing with anonea worthless"
_RSTOP = ", ".join(f"'{w}'" for w in vocab.RANK_STOP)


@query(f"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_\\-\\.]+')) w0 from documents), u as (select doc_id, trim(w0, '.') w from t), k as (select * from u where length(w) > 1 and w not in ({_RSTOP})),
 dl as (select d.doc_id, count(k.w) dl from documents d left join k on d.doc_id = k.doc_id group by 1), st as (select count(*) n, avg(dl) avgdl from dl),
 q as (select unnest(['pathetic', 'thing', 'anonea', 'worthless']) w), tf as (select doc_id, w, count(*) tf from k semi join q using (w) group by 1, 2), df as (select w, count(*) df from tf group by 1),
 s as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from tf join df using (w) join dl using (doc_id), st group by 1)
 select doc_id, round(score, 3) score from s order by 2 desc, 1 limit 20""")
def bm25_topk(spark, sf_dir):
    docs = binding.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return retrieval.bm25(docs, _QUESTION, top=20)


def _case(table: dict) -> str:
    return "case " + " ".join("when regexp_matches(q, '" + "|".join(f"(?:\\b{t}\\b)" for t in ts) + f"') then '{k}'" for k, ts in table.items()) + " end"


@query(f"""with x as (select conv_id, turn, lower(trim(coalesce(text, ''))) q from conversations where role = 'user') select conv_id, turn, {_case(vocab.SUBSIDIARIES)} subsidiary, {_case(vocab.METRICS)} metric, {_case(vocab.AGGREGATIONS)} aggregation from x""")
def route_entities(spark, sf_dir):
    q = binding.table(spark, sf_dir, "conversations").where("role = 'user'")
    return retrieval.routed(q).select("conv_id", "turn", "subsidiary", "metric", "aggregation")


def _or(patterns: list[str]) -> str:
    return "regexp_matches(q, '" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


_OUTSIDE = "regexp_matches(regexp_replace(q, '\\b(?:production\\s+target|target\\s+production)\\b', ' ', 'g'), '\\bproduction\\b')"
_ASK = {f: f"cast({_or(p)} as int)" if f != "production" else f"cast({_or(p)} and {_OUTSIDE} as int)" for f, p in vocab.ASKED.items()}
_DESC, _MEAS = " + ".join(_ASK[f] for f in vocab.DESCRIPTIVE), " + ".join(_ASK[f] for f in vocab.ASKED if f not in vocab.DESCRIPTIVE)


@query(f"""with x as (select lower(trim(coalesce(text, ''))) q from conversations where role = 'user'), e as (select q, {_case(vocab.SUBSIDIARIES)} sub, {_case(vocab.METRICS)} met, {_case(vocab.AGGREGATIONS)} agg,
 regexp_matches(q, '\\b(?:fy\\s*)?(20\\d{{2}})[-–/](\\d{{2,4}})\\b|\\b(20\\d{{2}})\\b') yr, {_or(vocab.NARRATIVE)} nar, regexp_matches(q, '\\b(which subsidiary|how much|total production|highest production)\\b') calc,
 case when {_or(vocab.ALL_DETAILS)} then 3 else {_DESC} end d, case when {_or(vocab.ALL_DETAILS)} then 7 else {_MEAS} end m from x),
 r as (select case when d + m >= 2 then (case when d = 0 then 'STRUCTURED' when m = 0 then 'DOCUMENT' else 'HYBRID' end)
 when (met is not null or (sub is not null and (yr or agg is not null)) or calc) then (case when nar then 'HYBRID' else 'STRUCTURED' end) else 'DOCUMENT' end route from e)
 select route, count(*) n from r group by 1""")
def route_batch(spark, sf_dir):
    q = binding.table(spark, sf_dir, "conversations").where("role = 'user'")
    return retrieval.routed(q).groupBy("route").agg(F.count("*").alias("n"))


#: Chunks in SQL: paragraphs, sentences with the heading in force, their running length, and from chunk to chunk by the places where it passes a limit.
_CHUNKS = r"""pa as (select doc_id, p.ordinality pn, trim(p.x, E' \t\n\r\f\v') x from documents, unnest(regexp_split_to_array(text, '\n\s*\n')) with ordinality p(x, ordinality)),
 hd as (select *, last_value(case when length(x) < 80 and x <> '' and not contains(x, E'\n') and right(x, 1) not in ('.', ':', ';') then x end ignore nulls) over (partition by doc_id order by pn) h from pa),
 se as (select doc_id, pn, h, s.ordinality sn, trim(s.y, E' \t\n\r\f\v') y from hd, unnest(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) with ordinality s(y, ordinality) where trim(s.y, E' \t\n\r\f\v') <> ''),
 li as materialized (select doc_id, list(y order by pn, sn) y, list(coalesce(h, '') order by pn, sn) h, list_prepend(0, list(c order by pn, sn)) c from (select *, sum(length(y)) over (partition by doc_id order by pn, sn) c from se) group by doc_id),
 ck as (select doc_id, 0 k, 0::bigint b, greatest(1, len(list_filter(c, lambda v: v <= 600)) - 1) e from li
  union all select ck.doc_id, k + 1, g.b, greatest(ck.e + 1, len(list_filter(c, lambda v: v <= c[g.b + 1] + 600)) - 1)
  from ck join li on ck.doc_id = li.doc_id, lateral (select greatest(ck.b, len(list_filter(c, lambda v: v < c[ck.e + 1] - 80))) b) g where ck.e < len(y)),
 cc as (select ck.doc_id, k, array_to_string(y[b + 1:e], ' ') content, h[least(e + 1, len(h))] heading, e = len(y) ended from ck join li on ck.doc_id = li.doc_id),
 fi as (select *, count(*) filter (length(content) >= 40) over (partition by doc_id) longs from cc),
 cs as (select doc_id, row_number() over (partition by doc_id order by k) - 1 chunk_index, content, heading from fi where length(content) >= 40 or (ended and longs = 0))"""


@query(f"with recursive {_CHUNKS} select doc_id document_id, count(*) chunks, cast(max(length(content)) as int) longest from cs group by 1")
def chunk_stats(spark, sf_dir):
    d = binding.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return retrieval.chunk_texts(d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))


@query(f"with recursive {_CHUNKS} select doc_id document_id, cast(chunk_index as int) chunk_index, sha256(content) content_hash, heading section_heading, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) token_count from cs")
def chunks(spark, sf_dir):
    d = binding.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return retrieval.chunk_texts(d).drop("content").withColumn("token_count", F.col("token_count").cast("long"))


@query("select doc_id, sha256(trim(text)) h, length(text) n from documents")
def content_hashes(spark, sf_dir):
    return binding.table(spark, sf_dir, "documents").select("doc_id", scalars.content_hash(F.col("text")).alias("h"), F.length("text").cast("long").alias("n"))


# questions

_ASKED = """q as (select r_regionkey * 10 + k question_id, cast(null as varchar) mine, r_name subsidiary, case k when 0 then '1995-96' when 1 then '1996-97' end as "year", case k when 0 then 'production' when 1 then 'target' else 'dispatch' end metric, case k when 0 then 'max' when 1 then 'avg' when 3 then 'min' end aggregation from region, (select unnest([0, 1, 2, 3]) k)
  union all select r_regionkey * 10 + k, null, null, case k when 4 then '1995-96' when 5 then '1996-97' end, case k when 4 then 'production' when 5 then 'target' else 'dispatch' end, case k when 4 then 'max' when 5 then 'avg' when 7 then 'min' end from region, (select unnest([4, 5, 6, 7]) k)
  union all select 100 + n_nationkey, n_name, r_name, case when n_nationkey % 2 = 0 then '1994-95' end, 'production', 'sum' from nation join region on n_regionkey = r_regionkey)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each region what it produced and the like, of all together the same, and of each nation as a mine."""
    k = F.explode(F.array(*map(F.lit, range(8))))
    region = binding.table(spark, sf_dir, "region")
    q = region.select("r_regionkey", "r_name", k.alias("k"))
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.col("k") % 4 + 1)
    some = lambda c: F.nullif(c, F.lit(""))
    none = F.lit(None).cast("string")
    asked = q.select((F.col("r_regionkey") * 10 + F.col("k")).alias("question_id"), none.alias("mine"), F.when(F.col("k") < 4, F.col("r_name")).alias("subsidiary"), some(pick("1995-96", "1996-97", "", "")).alias("year"), pick("production", "target", "dispatch", "dispatch").alias("metric"), some(pick("max", "avg", "", "min")).alias("aggregation"))
    mines = binding.table(spark, sf_dir, "nation").join(region, F.expr("n_regionkey = r_regionkey"))
    return asked.unionByName(mines.select((100 + F.col("n_nationkey")).alias("question_id"), F.col("n_name").alias("mine"), F.col("r_name").alias("subsidiary"), F.when(F.col("n_nationkey") % 2 == 0, "1994-95").alias("year"), F.lit("production").alias("metric"), F.lit("sum").alias("aggregation")))


@query(f"""with {O}, {_ASKED}, x as (select q.*, o.mine as name, record_id, case q.metric when 'production' then production when 'target' then target else dispatch end v
  from q left join o on (q."year" is null or o.financial_year = q."year") and case when q.mine is not null then o.mine = q.mine when q.subsidiary is not null then o.subsidiary = q.subsidiary else true end),
 y as (select *, case when mine is not null or subsidiary is not null then 'lookup' else coalesce(aggregation, 'sum') end calculation from x)
 select question_id, mine, subsidiary, "year", metric, aggregation, calculation, case calculation when 'lookup' then arg_min(v, record_id) filter (where v is not null) when 'max' then max(v) when 'min' then min(v) when 'avg' then round(cast(sum(cast(v as decimal(28,8))) as double) / count(v), 2) else {S('v')} end as "value",
 case calculation when 'lookup' then arg_min(name, record_id) filter (where v is not null) when 'max' then arg_max(name, (v, -record_id)) filter (where v is not null) when 'min' then arg_min(name, (v, record_id)) filter (where v is not null) end as name, count(v) n from y group by 1, 2, 3, 4, 5, 6, 7""")
def answer_batch(spark, sf_dir):
    return answers.answered(_questions(spark, sf_dir), binding.order_records(spark, sf_dir)).drop("answer")


@query(f"""with {O}, {_ASKED}, x as (select question_id, q.subsidiary, q."year", q.metric, aggregation, financial_year fy, case q.metric when 'production' then production when 'target' then target else dispatch end v from q join o on o.subsidiary = q.subsidiary where q.mine is null),
 y as (select question_id, subsidiary, "year", metric, aggregation, {S("case when fy < '1995-00' then v end")} past, {S("case when fy >= '1995-00' then v end")} "current" from x group by 1, 2, 3, 4, 5)
 select *, round("current" - past, 2) difference, {_PCT} pct from y""")
def compare_batch(spark, sf_dir):
    r = binding.order_records(spark, sf_dir)
    return answers.compared(_questions(spark, sf_dir).where("mine is null and subsidiary is not null").drop("mine"), r.where(_PAST), r.where(_NOW))


# datasets of key-value rows

_KV = f"""{O}, kv0 as (select record_id, record_id % 50 dataset_id, upper(subsidiary) subsidiary, record_id % 5 l, floor(production) number, case when record_id % 3 = 0 then financial_year end fy from o),
 kv as (select *, case l when 0 then 'production' when 1 then 'target' when 2 then 'dispatch' when 4 then 'production' end metric, l = 0 summary from kv0 where l <> 3),
 dt as (select dataset_id, metric, coalesce(round(cast(sum(case when not summary then cast(number as decimal(28,8)) end) as double), 2), round(cast(sum(case when summary then cast(number as decimal(28,8)) end) as double), 2)) total from kv group by 1, 2),
 dy as (select dataset_id, arg_min(fy, record_id) as "year" from kv0 where fy is not null group by 1)"""


@query(f"with {_KV} select metric, {S('number')} total from kv group by 1")
def key_value_totals(spark, sf_dir):
    return datasets.key_value_totals(binding.key_values(spark, sf_dir))


@query(f"with {_KV} select * from dt")
def dataset_totals(spark, sf_dir):
    return datasets.dataset_totals(binding.key_values(spark, sf_dir))


@query(f"""with {_KV}, g as (select "year" as period, {S('total')} as "value" from dt join dy using (dataset_id) where metric = 'production' group by 1)
 select *, case when lag("value") over w > 0 then round(("value" - lag("value") over w) / lag("value") over w * 100, 1) end growth_pct from g window w as (order by period)""")
def trend_from_datasets(spark, sf_dir):
    return datasets.trend_from_datasets(binding.key_values(spark, sf_dir))


@query(f"""with {_KV}, t as (select {S("case when metric = 'production' then total end")} production, {S("case when metric = 'target' then total end")} target, {S("case when metric = 'dispatch' then total end")} dispatch from dt)
 select *, case when target > 0 then round(production / target * 100, 2) end achievement_pct, (select count(distinct mine) from o) mines, (select count(distinct upper(subsidiary)) from o) subsidiaries from t""")
def report_aggregates(spark, sf_dir):
    return datasets.report_aggregates(binding.key_values(spark, sf_dir))


@query(f"with {_KV} select subsidiary, metric, arg_max(number, record_id) as \"value\" from kv group by 1, 2")
def source_profile(spark, sf_dir):
    return datasets.source_profile(binding.key_values(spark, sf_dir))


@query("select count(*) n, min(doc_id) lowest from documents where contains(lower(text), 'pathetic') or contains(lower(text), 'anonea')")
def rank_candidates(spark, sf_dir):
    docs = binding.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return datasets.candidates(docs, "pathetic anonea").agg(F.count("*").alias("n"), F.min("doc_id").alias("lowest"))


# catalogues and log


@query(f"with {M} select count(*) mines, {S('production')} total_production, round(cast(sum(cast(production as decimal(28,8))) as double) / count(production), 3) avg_production, count(distinct subsidiary) subsidiaries, count(distinct state) states from m")
def map_stats(spark, sf_dir):
    return catalogue.place_stats(binding.mines(spark, sf_dir))


@query(f"with {M} select subsidiary grp, count(*) n, {S('production')} total from m group by 1")
def map_by_subsidiary(spark, sf_dir):
    return catalogue.counts_by(binding.mines(spark, sf_dir), "subsidiary", "production")


@query(f"with {M} select mine_id, mine_name, state from m where lower(subsidiary) = 'asia' and (contains(lower(mine_name), '1') or contains(lower(state), '1'))")
def map_filter(spark, sf_dir):
    return catalogue.matching(binding.mines(spark, sf_dir), {"subsidiary": "asia", "state": ""}, search="1", search_in=["mine_name", "state"]).select("mine_id", "mine_name", "state")


@query(f"with {M} select distinct field, value from (select unnest(['subsidiary', 'state']) field, unnest([subsidiary, state]) value from m)")
def map_options(spark, sf_dir):
    return catalogue.choices(binding.mines(spark, sf_dir), ["subsidiary", "state"])


@query("select event_id, event_type, user_id from events where event_type = 'click' and cast(ts as date) between date '2024-01-05' and date '2024-01-12' order by ts desc, event_id limit 100")
def audit_filter(spark, sf_dir):
    e = binding.table(spark, sf_dir, "events").withColumnRenamed("ts", "timestamp")
    return catalogue.slice_of(catalogue.audit(e, "click", since="2024-01-05", until="2024-01-12"), [F.desc("timestamp"), "event_id"], limit=100).select("event_id", "event_type", "user_id")


@query("select date_trunc('hour', ts) start, event_type, count(*) n, cast(round(sum(cast(value as decimal(28,8))), 2) as double) total from events group by 1, 2")
def event_windows(spark, sf_dir):
    return event_counts(binding.table(spark, sf_dir, "events"))


# provenance


@query("""with p as (select l_orderkey k, l_linestatus s, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_linestatus) r from lineitem)
 select o_orderkey record_id, p.s first_sheet, (select count(*) from lineitem where l_orderkey = o_orderkey) provenance_count from orders left join p on p.k = o_orderkey and r = 1""")
def first_provenance(spark, sf_dir):
    li = binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.struct("l_linenumber", "l_partkey", "l_linestatus").alias("provenance_id"), F.col("l_linestatus").alias("sheet_name"))
    o = binding.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"))
    first = schema.first_provenance(o, li).select("record_id", F.col("sheet_name").alias("first_sheet"))
    return first.join(schema.drilldown(o, li).select("record_id", "provenance_count"), "record_id")
