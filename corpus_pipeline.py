"""A training corpus from raw documents, in five stages; each works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import alike, bpe, mixing, quality, simhash, spans
from strataframe.llm.components import connected_components
from strataframe.llm.shared import fresh, stored, table


def _row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The document's id; for a null one a number of its text's, above the ids in use."""
    number = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(1 << 62) + number)


def _digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble, trained on the labels that are not held out, scores 0.3 or more.

    Null and empty texts are judged as texts without words. No documents: no rows.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), spark)
    return quality.keep(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id, then by hash of its text and of its other columns.

    Rows with one id and different texts that are not near stay. Near are fingerprints within 3 bits, and texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.
    A row with a null id goes by its text: it stays if no other of its group has an id or a lower number. Rows that are equal in every column are one.
    """
    # columns go by place, so their names can't clash; of the rows of one text only the least can stay, so each text is kept once, with that row
    own = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = own[docs.columns.index("doc_id")], own[docs.columns.index("text")]
    placed = docs.toDF(*own)
    others = F.struct(F.col(text).isNull().alias("no_text"), *[F.col(c) for c in own if c not in (doc_id, text)])
    rows = placed.select(_digest(F.coalesce(text, F.lit(""))).alias("h"), F.struct(_row_id(doc_id, text).alias("number"), _digest(F.to_json(others)).alias("rest")).alias("least"), F.struct(*own).alias("row"))
    rows = rows.groupBy("h").agg(F.min("least").alias("least"), F.min_by("row", "least").alias("row"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("id"), F.struct("least.number", "h", "least.rest").alias("least"), "row.*"), spark)
    texts = rows.select("id", F.coalesce(text, F.lit("")).alias("text"))
    prints = simhash.near_duplicates(texts.select(F.col("id").alias("doc_id"), "text"), spark).select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    edges = prints.unionByName(alike.links(texts, spark).select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = connected_components(edges, spark).join(rows.select("id", "least"), "id")
    keep = groups.groupBy("component_id").agg(F.min_by("id", "least").alias("id"))
    # a text that is near no other is in no group
    gone = stored(groups.select("id").join(keep.select("id"), "id", "left_anti"), spark)
    return rows.join(gone, "id", "left_anti").select(own).toDF(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated runs of sentences out of all but their first document. Every row stays; ``n_chars`` is recounted. A column named ``n_removed`` goes."""
    return spans.dedup(docs, spark).drop("n_removed")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it: 0 to 2 copies. Rows that repeat an id with its text take the fewest any of them got."""
    key, copies, copy = fresh(docs, "row_key_", "copies_", "copy_")
    keyed = docs.withColumn(key, F.concat_ws(":", _row_id(), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    mixed = mixing.mix(keyed.select(F.col(key).alias("doc_id"), "text", "source"), spark)
    mixed = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.min("copies").alias(copies)).where(F.col(copies) > 0)
    return keyed.join(mixed, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, copies, copy)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number and the digests of ids and decoded bytes, a row for each copy."""
    return bpe.round_trip(docs, spark, ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]

#: The quality model and BPE have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), spark)
    return docs
