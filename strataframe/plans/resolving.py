"""Queries of resolved questions and of answers from chunks over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators import index, resolve
from strataframe.plans import binding, indexing
from strataframe.plans.queries import _PLACES, query


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of five owners: one owner has summary rows (a label, a value and a note with the year) among rows of a table, whose year stands in a remark."""
    o = binding.table(spark, sf_dir, "orders").join(binding.places(spark, sf_dir), F.expr("o_custkey = c_custkey"))
    k, y = F.col("o_orderkey"), F.col("o_orderkey") % 8
    p = F.floor("o_totalprice").cast("long").cast("string")
    label = F.when(k % 20 == 0, "Total Production").otherwise("Production Target")
    entry = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    kv = entry("Field", label, "Value", F.concat(F.lit("n "), p, F.lit(" MT")), "Note", F.concat(F.lit("for FY 200"), y, F.lit("-0"), y + 1))
    row = entry("subsidiary", F.col("r_name"), "mine", F.concat(F.lit("Mine"), F.col("c_custkey") % 50, F.lit(" (UG)")), "production", p, "Remarks", F.concat(F.lit("Year 200"), y))
    row = F.when(k % 3 == 0, F.map_concat(row, entry("production_unit", "kt"))).otherwise(row)
    return o.select(F.col("o_orderpriority").alias("scope"), k.alias("record_id"), k.alias("row_index"), F.when((F.col("o_orderpriority") == "1-URGENT") & (k % 10 == 0), kv).otherwise(row).alias("data"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight questions a region: a summary, a subsidiary, the highest of a year, an average, a total, a mine, an unknown subsidiary, and one without a metric."""
    r = binding.table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    k, n = F.col("k"), F.col("r_regionkey")
    scope = F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "2-HIGH", "3-MEDIUM", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "5-LOW"))), k + 1)
    text = F.when(k == 4, "Total production please").when(k == 5, F.concat(F.lit("Output of mine"), n, F.lit(" now"))).otherwise("How much")
    return r.select(
        (n * 10 + k).cast("long").alias("question_id"), scope.alias("scope"), text.alias("text"), F.when(k == 1, F.lower("r_name")).when(k == 6, "NOWHERE").alias("subsidiary"),
        F.when(k == 0, F.concat(F.lit("FY 200"), n, F.lit("–0"), n + 1)).when(k == 2, F.concat(F.lit("200"), n)).alias("year"), F.when(k != 7, "production").alias("metric"), F.when(k.isin(2, 4), "max").when(k == 3, "avg").alias("aggregation"))


_RESOLVED = f"""o as (select o_orderkey k, o_orderpriority scope, r_name sub, 'Mine' || c_custkey % 50 || ' (UG)' mine, cast(cast(floor(o_totalprice) as bigint) as varchar) p, o_orderkey % 8 y, o_orderpriority = '1-URGENT' and o_orderkey % 10 = 0 doc from {_PLACES}),
 c as (select scope, k, doc, p || case when doc then ' MT' else '' end fmt, cast(p as double) num, case when not doc and k % 3 = 0 then 'kt' else 'MT' end unit, case when not doc then sub end sub, case when not doc then mine end mine,
  case when doc then 'total production n ' || p || ' mt for fy 200' || y || '-0' || (y + 1) else p || ' year 200' || y end txt from o where not doc or k % 20 = 0),
 q as (select r_regionkey * 10 + k question_id, ['1-URGENT', '2-HIGH', '2-HIGH', '3-MEDIUM', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '5-LOW'][k + 1] scope, k, r_regionkey n, case k when 1 then r_name when 6 then 'NOWHERE' end sub, case k when 0 then '200' || r_regionkey || '-0' || (r_regionkey + 1) when 2 then '200' || r_regionkey end yr from region, (select unnest(range(8)) k)),
 j as (select q.question_id, q.k kind, q.n, q.sub asked, c.* exclude (scope, k), c.k rec from q join c on q.scope = c.scope where q.k <> 7 and (q.yr is null or contains(c.txt, q.yr))),
 a as (select question_id, sum(num) filter (not doc) total, count(num) filter (not doc) n, arg_min(unit, rec) filter (not doc) unit, arg_min(mine, rec) filter (not doc) mine, min(rec) filter (not doc) rec, bool_or(doc) summed from j group by 1),
 s as (select *, row_number() over (partition by question_id order by case when kind = 2 then -num end, rec) i from j where case kind when 0 then doc when 1 then sub = asked when 2 then not doc when 5 then starts_with(lower(mine), 'mine' || n || ' ') else false end)
 select q.question_id, true found, 'lookup' calculation, 'Production' metric_display, s.sub subsidiary, s.mine, s.num as "value", s.fmt formatted, s.unit, s.rec record_id, cast(null as varchar) reason from q join s on q.question_id = s.question_id and s.i = 1 where q.k in (0, 1, 5)
 union all select q.question_id, true, 'max', 'Production', s.sub, s.mine, s.num, s.fmt, s.unit, s.rec, null from q join s on q.question_id = s.question_id and s.i = 1 where q.k = 2
 union all select q.question_id, true, 'avg', 'Average production', null, mine, total / a.n, format('{{:,.2f}} ', total / a.n) || unit, unit, rec, null from q join a using (question_id) where q.k = 3
 union all select q.question_id, true, 'sum', 'Total production', null, mine, total, format('{{:,}} ', cast(total as bigint)) || unit, unit, rec, null from q join a using (question_id) where q.k = 4
 union all select question_id, false, null, null, null, null, null, null, null, null, case when k = 6 then 'No record found for subsidiary NOWHERE' when k = 7 then 'No structured metric identified in query.' when k = 1 then 'No record found for subsidiary ' || lower(sub) else 'I could not find a sufficiently specific value for that field in the selected document.' end
  from q where k in (6, 7) or (k in (0, 1, 2) and question_id not in (select question_id from s)) or (k = 5 and false)"""


@query(f"with {_RESOLVED}")
def resolved_questions(spark, sf_dir):
    return resolve.resolved(_questions(spark, sf_dir), _records(spark, sf_dir))


@query("""with o as (select o_orderkey k, o_orderkey % 5 m from orders) select k question_id, case m when 0 then 'fields' when 1 then 'fields' when 2 then 'none' when 3 then 'sentence' else 'absent' end kind,
 case m when 0 then 'According to Order ' || k || ': Production: ' || k || ' MT; Production Target: 7.' when 1 then 'According to Order ' || k || ': Coal Grade: G' || k % 10 || '.' when 2 then 'I could not find sufficient evidence in the available project data.'
 when 3 then 'According to verified project records in Order ' || k || ' (Page 3): Mines closed in ' || k || '!.' else 'I could not find that information in the selected document.' end answer from o""")
def chunk_answers(spark, sf_dir):
    """A question an order, over chunks of five kinds: keys in the first chunk or the second, no chunk, a sentence, and a chunk without what is asked."""
    o = binding.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    k, m = F.col("k"), F.col("k") % 5
    q = o.select(k.alias("question_id"), F.when(m == 0, "What was the production?").when(m == 1, "Which grade is it").when(m == 3, F.concat(F.lit("Tell me what closed "), k)).when(m == 4, "net worth").alias("text"))
    first = F.when(m == 0, F.concat(F.lit("Intro text. Output was high.\nproduction: "), k, F.lit(" MT\n\nProduction target =  7"))).when(m == 1, "nothing here").when(m == 3, F.concat(F.lit("It rained. Mines closed in "), k, F.lit("! Again it rained."))).when(m == 4, "Sales: 4")
    second = F.when(m == 1, F.concat(F.lit("Ash: 3\nCoal grade - G"), (k % 10))).when(m == 0, "Production: never")
    chunk = lambda rank, content: o.select(k.alias("question_id"), F.lit(rank).alias("rank"), content.alias("content"), F.concat(F.lit("Order "), k).alias("document_title"), F.lit(3).alias("page_number")).where("content is not null")
    return resolve.answers_from_chunks(q, chunk(1, first).unionByName(chunk(2, second)))


@query(f"""with o as (select o_orderkey k, o_orderkey % 8 y, r_name sub, cast(floor(o_totalprice) as double) v, o_orderkey % 7 = 0 ref from {_PLACES}),
 f as (select sub, ref, y, arg_min(v, k) v from o group by 1, 2, 3), w as (select sub, ref, arg_min(v, k) v from o group by 1, 2), q as (select r_regionkey question_id, r_name sub from region),
 v as (select q.question_id, q.sub, coalesce(a.v, a2.v) now, coalesce(b.v, b2.v) was, case when a.v is null then 'current period' else '2005-06' end ny, case when b.v is null then 'baseline period' else '2002-03' end wy
  from q left join f a on a.sub = q.sub and not a.ref and a.y = 5 left join f b on b.sub = q.sub and b.ref and b.y = 2 join w a2 on a2.sub = q.sub and not a2.ref join w b2 on b2.sub = q.sub and b2.ref),
 j as (select *, round(now - was, 2) difference, case when was <> 0 then round(round(now - was, 2) / was * 100, 2) end pct from v)
 select question_id, 'compared' kind, now current_value, was baseline_value, difference, pct, sub || ' Production was ' || cast(cast(now as bigint) as varchar) || '.0 MT in ' || ny || ', compared with ' || cast(cast(was as bigint) as varchar) || '.0 MT in ' || wy || '. The ' ||
  case when difference >= 0 then 'increase' else 'decrease' end || ' was ' || printf('%.2f', abs(difference)) || ' MT (' || printf('%.1f', abs(pct)) || '%).' answer, 'HIGH' confidence from j""")
def compared_questions(spark, sf_dir):
    """One question a region, which names two years, over own orders and reference ones."""
    o = binding.table(spark, sf_dir, "orders").join(binding.places(spark, sf_dir), F.expr("o_custkey = c_custkey"))
    k, y = F.col("o_orderkey"), F.col("o_orderkey") % 8
    data = F.create_map(F.lit("subsidiary"), F.col("r_name"), F.lit("production"), F.floor("o_totalprice").cast("long").cast("string"), F.lit("period"), F.concat(F.lit("200"), y, F.lit("-0"), y + 1))
    rows = o.select(F.lit("me").alias("scope"), k.alias("record_id"), k.alias("row_index"), data.alias("data"))
    none = F.lit(None).cast("string")
    q = binding.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("question_id"), F.lit("me").alias("scope"), F.lit("Compare production of FY 2005-06 with that of 2002–03").alias("text"), F.col("r_name").alias("subsidiary"), F.lit("2005-06").alias("year"), F.lit("production").alias("metric"), none.alias("aggregation"))
    return resolve.compared_answers(q, rows.where("record_id % 7 <> 0"), rows.where("record_id % 7 = 0").withColumn("scope", none))


@query(f"""with {indexing._RANKED}, o as (select o_orderkey k, r_name sub, cast(cast(floor(o_totalprice) as bigint) as varchar) p from {_PLACES}), f as (select sub, min(k) k, arg_min(p, k) p from o where k % 7 = 0 group by 1),
 z as (select item_id question_id, case when item_id % 4 = 0 then ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', 'NOWHERE'][item_id % 6 + 1] end sub from benchmark),
 t as (select question_id, arg_min(chunk_id, "rank") c, arg_min(score, "rank") score, count(*) n from r where "rank" <= 3 and score >= 0.1 group by 1)
 select z.question_id, case when f.k is not null then 'STRUCTURED' else 'DOCUMENT' end query_type, case when f.k is not null then 'According to the authorized organization historical report (Order ' || f.k || '), Production was ' || f.p || ' MT.'
   when t.c is not null then 'According to authorized organization reference records in Document ' || t.c || ': ' || substr(d.text, 1, 200) || '.' else 'I could not find sufficient evidence in the authorized organization reference data.' end answer,
  case when f.k is not null or t.score >= 1 then 'HIGH' when t.score >= 0.4 then 'MEDIUM' else 'LOW' end confidence, case when f.k is not null then 1 else coalesce(t.n, 0) end evidence
 from z left join f on z.sub = f.sub left join t on t.question_id = z.question_id left join documents d on d.doc_id = t.c""")
def organization_history(spark, sf_dir):
    """Passages as questions to the reference: a quarter name a region, whose first reference order answers; the others, and those of no region, are answered by the first of three chunks."""
    i = F.col("question_id")
    names = F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "NOWHERE"))), (i % 6 + 1).cast("int"))
    none = F.lit(None).cast("string")
    asked = indexing._questions(spark, sf_dir)
    q = asked.select("question_id", none.alias("scope"), "text", F.when(i % 4 == 0, names).alias("subsidiary"), none.alias("year"), F.when(i % 4 == 0, "production").alias("metric"), none.alias("aggregation"))
    o = binding.table(spark, sf_dir, "orders").join(binding.places(spark, sf_dir), F.expr("o_custkey = c_custkey")).where("o_orderkey % 7 = 0")
    k = F.col("o_orderkey")
    records = o.select(none.alias("scope"), k.alias("record_id"), k.alias("row_index"), F.create_map(F.lit("subsidiary"), F.col("r_name"), F.lit("production"), F.floor("o_totalprice").cast("long").cast("string")).alias("data"))
    titles = o.select(k.alias("record_id"), F.concat(F.lit("Order "), k).alias("document_title"))
    path, chunks = indexing._folder(spark), indexing._searchable(spark, sf_dir)
    index.build(chunks, spark, path)
    found = index.search(spark, path, asked, top=3).join(chunks.select("chunk_id", "content", F.concat(F.lit("Document "), "chunk_id").alias("document_title")), "chunk_id")
    return resolve.organization_answers(q, records, titles, found)
