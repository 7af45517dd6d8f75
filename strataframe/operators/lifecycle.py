"""Documents on their way through the system: batches of uploads, retries, status, details of an extraction, and what is to be indexed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of a batch, statuses from which a document can be tried again, and those in which it is indexed.
MOST_FILES, MOST_BYTES = 10, 100 << 20
RETRIED_FROM = ("failed", "needs_review", "queued", "uploaded")
INDEXED_IN = ("indexed", "needs_review", "completed", "processed")


def batches(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``files(batch_id, length)`` to (batch_id, files, bytes, reason): null, or the limit that the batch is over, the count before the size."""
    out = files.groupBy("batch_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return out.withColumn("reason", F.when(F.col("files") > most_files, "count").when(F.col("bytes") > most_bytes, "size"))


def retried(documents: DataFrame, jobs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) after ``requests(document_id)``, each counting once.

    ``documents(document_id, status)`` go back to ``queued`` from the statuses that allow it; pending and running ``jobs(document_id, status)`` of such a
    document fail, as a new pending job takes their place. Other documents and their jobs stay as they are.
    """
    asked = requests.select("document_id").distinct().withColumn("asked_", F.lit(True))
    marked = documents.join(asked, "document_id", "left").withColumn("again_", F.coalesce("asked_", F.lit(False)) & F.col("status").isin(*RETRIED_FROM))
    again = marked.where("again_").select("document_id")
    old = jobs.join(again.withColumn("again_", F.lit(True)), "document_id", "left")
    old = old.withColumn("status", F.when(F.col("again_") & F.col("status").isin("pending", "running"), "failed").otherwise(F.col("status"))).drop("again_")
    new = again.withColumn("status", F.lit("pending"))
    return marked.withColumn("status", F.when(F.col("again_"), "queued").otherwise(F.col("status"))).drop("asked_", "again_"), old.select("document_id", "status").unionByName(new)


def status_of(documents: DataFrame, owner: str, document_id: int) -> DataFrame:
    """The owner's own document, or no row."""
    return documents.where((F.col("owner") == owner) & (F.col("document_id") == document_id)).select("document_id", "status")


def extraction_detail(documents: DataFrame, extractions: DataFrame, findings: DataFrame, provenance: DataFrame, most: int = 50) -> DataFrame:
    """``extractions(document_id, tables array)`` of documents that are not archived, with ``tables_count``, ``has_provenance`` and their first ``most`` findings by id."""
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("finding_id"))
    first = findings.withColumn("rank_", rank).where(F.col("rank_") <= most)
    listed = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("finding_id", "issue_type", "severity"))).alias("findings"))
    out = documents.where(~F.col("is_archived")).select("document_id").join(extractions, "document_id").join(listed, "document_id", "left")
    out = out.join(provenance.select("document_id").distinct().withColumn("p_", F.lit(True)), "document_id", "left")
    return out.withColumn("tables_count", F.size("tables")).withColumn("has_provenance", F.coalesce("p_", F.lit(False))).drop("p_", "tables")


def to_index(documents: DataFrame, owner: str | None = None) -> DataFrame:
    """Documents that are indexed again when all are: those in an indexable status, not archived, of one owner or of all."""
    out = documents.where(F.col("status").isin(*INDEXED_IN) & ~F.col("is_archived"))
    return out.where(F.col("owner") == owner) if owner else out
