"""Queries of the chunk index, the inverted index and the ledger over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import vocab
from strataframe.operators import index
from strataframe.plans import binding
from strataframe.plans.queries import _CHUNKS, query
from strataframe.sources import ledger
from strataframe.sources.staging import shared_dir, stored


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strataframe/{uuid.uuid4().hex}"


# a batch of questions against the inverted index


def _searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: found in the scope of all and in that of their source; source and language are the heading."""
    d = binding.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.array(F.lit("all"), F.concat(F.lit("o:"), "source")).alias("scopes"), F.col("text").alias("content"), F.concat_ws(" ", "source", "lang").alias("section_heading"), F.concat(F.lit("doc:"), "doc_id").alias("source_ref"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as questions: some of their words, some with a source's name, half of them to all documents and half to one source's."""
    i, text = F.col("item_id"), F.substring("text", 1, 60)
    words = F.when(i % 3 == 0, F.concat_ws(" ", text, F.concat(F.lit("src"), (i % 20).cast("string")))).otherwise(text)
    scope = F.when(i % 2 == 0, "all").when(i % 5 == 0, "o:nobody").otherwise(F.concat(F.lit("o:src"), (i % 20).cast("string")))
    return binding.table(spark, sf_dir, "benchmark").select(i.alias("question_id"), scope.alias("scope"), words.alias("text"))


_STOP = ", ".join(f"'{w}'" for w in vocab.RANK_STOP)
_TOKENS = lambda c: f"list_filter(list_transform(regexp_extract_all(lower({c}), '[a-zA-Z0-9_\\-\\.]+'), lambda w: trim(w, '.')), lambda w: length(w) > 1 and w not in ({_STOP}))"
_RANKED = f"""d as (select doc_id chunk_id, source, lower(coalesce(text, '')) low, lower(concat_ws(' ', source, lang)) head, {_TOKENS("coalesce(text, '')")} || {_TOKENS("concat_ws(' ', source, lang)")} ts from documents),
 c as (select chunk_id, 'all' scope, ts from d union all select chunk_id, 'o:' || source, ts from d where source is not null),
 st as (select scope, count(*) chunks, greatest(1.0, avg(len(ts))) avgdl from c group by 1),
 q0 as (select item_id question_id, case when item_id % 2 = 0 then 'all' when item_id % 5 = 0 then 'o:nobody' else 'o:src' || item_id % 20 end scope, substr(text, 1, 60) || case when item_id % 3 = 0 then ' src' || item_id % 20 else '' end t from benchmark),
 q as (select *, {_TOKENS("t")} ts from q0),
 qt as (select question_id, scope, w, count(*) times from (select question_id, scope, unnest(ts) w from q) group by 1, 2, 3),
 po as (select scope, w, chunk_id, dl, count(*) tf from (select scope, chunk_id, len(ts) dl, unnest(ts) w from c) where w in (select w from qt) group by 1, 2, 3, 4),
 df as (select scope, w, count(*) df from po group by 1, 2),
 b as (select question_id, chunk_id, sum(times * ln(1 + (chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) base from qt join po using (scope, w) join df using (scope, w) join st using (scope) group by 1, 2),
 s as (select question_id, chunk_id, round(base + case when contains(low, array_to_string(q.ts, ' ')) then 0.5 else 0 end + case when len(list_filter(q.ts, lambda x: contains(head, x))) > 0 then 0.3 else 0 end, 3) score from b join d using (chunk_id) join q using (question_id)),
 r as (select *, row_number() over (partition by question_id order by score desc, chunk_id) as "rank" from s)"""


@query(f"with {_RANKED} select question_id, cast(\"rank\" as int) as \"rank\", chunk_id, score from r where \"rank\" <= 10 and score >= 0.1")
def bm25_batch(spark, sf_dir):
    path = _folder(spark)
    index.build(_searchable(spark, sf_dir), spark, path)
    return index.search(spark, path, _questions(spark, sf_dir), top=10)


@query(f"""with {_RANKED}, t as (select r.*, doc_id, text from r join documents on chunk_id = doc_id where "rank" <= 3 and score >= 0.1)
 select question_id, sha256(string_agg(text, chr(10) || chr(10) order by "rank")) context, string_agg('doc:' || doc_id, ' ' order by "rank") sources from t group by 1""")
def narrative_context(spark, sf_dir):
    """The first three chunks of each question, as a report's narrative takes them."""
    path, chunks = _folder(spark), _searchable(spark, sf_dir)
    index.build(chunks, spark, path)
    found = index.narrative_context(spark, path, _questions(spark, sf_dir), chunks)
    return found.select("question_id", F.sha2("context", 256).alias("context"), F.array_join("sources", " ").alias("sources"))


# the chunk index, kept up by fingerprint


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a status and an extraction: some are not ready, some were read without OCR."""
    i = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("indexed", "processed", "failed", "completed", "needs_review", "uploaded"))), (i % 6 + 1).cast("int"))
    taken = F.when(i % 5 == 0, "ocr_unavailable").when(i % 7 == 0, "failed").otherwise("completed")
    table = "array<struct<source_ref:string,sheet_name:string,section_heading:string,headers:array<string>,rows:array<array<string>>>>"
    return binding.table(spark, sf_dir, "documents").select(i.alias("document_id"), status.alias("status"), taken.alias("extraction_status"), F.col("text").alias("raw_text"), F.array().cast(table).alias("tables"))


@query(f"""with recursive {_CHUNKS}, n as (select doc_id, count(*) n from cs group by 1), e as (select doc_id, coalesce(n, 0) n, doc_id % 10 = 3 edited from documents left join n using (doc_id) where doc_id % 6 not in (2, 5) and (doc_id % 5 = 0 or doc_id % 7 <> 0)),
 f as (select 'first' run, count(*) documents, sum(n) chunks from e union all select 'again', 0, (select sum(n) from e) union all select 'edited', count(*) filter (edited), sum(case when edited then 1 else n end) from e)
 select run, cast(documents as bigint) documents, cast(chunks as bigint) chunks from f""")
def indexed_runs(spark, sf_dir):
    """Three runs: all documents, the same again, and with a tenth of them rewritten to one sentence each."""
    path, docs = _folder(spark), stored(_extracted(spark, sf_dir), spark)
    after = docs.withColumn("raw_text", F.when(F.col("document_id") % 10 == 3, F.concat(F.lit("Rewritten document "), "document_id", F.lit("."))).otherwise(F.col("raw_text")))
    out = None
    for run, rows in (("first", docs), ("again", docs), ("edited", after)):
        n = index.index_documents(spark, rows, path, f"{len(run)}-{run}")
        state = index.current_chunks(spark, path).agg(F.count("*").alias("chunks")).select(F.lit(run).alias("run"), F.lit(n).cast("long").alias("documents"), "chunks")
        state = stored(state, spark)  # as it is after this run
        out = state if out is None else out.unionByName(state)
    return out


# batches that are appended once


@query("select event_type, count(*) n, count(distinct event_id % 3) batches from events group by 1")
def appended_once(spark, sf_dir):
    """Events in three batches, each appended twice."""
    path, e = _folder(spark), binding.table(spark, sf_dir, "events").select("event_id", "event_type")
    for k in (0, 1, 2, 2, 1, 0):
        ledger.append_once(spark, path, f"day-{k}", {"events": e.where(F.col("event_id") % 3 == k)})
    rows = ledger.committed(spark, path, "events", "event_id long, event_type string")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("batch").alias("batches"))
