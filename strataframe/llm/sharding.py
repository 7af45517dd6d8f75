"""Operator 10: shards that each match the mixture, by proportional stratified interleaving.

Rows are ranked in seeded hash order within their source; the rank as a fraction of its source spreads every source
evenly over (0, 1), so any run of the rows sorted by that fraction holds the sources in proportion. The sorted
rows are cut into shards whose row counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.shared import stored, table

#: Parts of each order. Ranks are a part's offset, from a table of counts, plus the rank within the part.
PARTS = 4096
#: Hash seed of the order within a source.
SEED = 20240229


def shard(docs: DataFrame, spark: SparkSession, shards: int = 40, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``(doc_id, source, size, text_crc32, text_group, law, shard, slot, grown_shard)``, a row a document.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. ``slot`` runs from 0 in each shard, in the interleaved
    order. The null source is a stratum of its own; repeated ids and texts are rows of their own, told apart by id, then
    checksum and size. Fewer rows than shards leave shards empty; no rows give none. Very long texts count whole; other columns are ignored.

    Groups are equal texts, named by ``text_group`` (a 64-bit hash; null texts are empty). Law ``rows`` does not keep a group together: a group may hold a third
    of all rows, more than a shard, so its rows are dealt like any others of their sources and lie over several shards. Who needs groups whole can drop copies
    before, by ``text_group``.

    No task ranks a whole source or the whole table: both orders are cut into hash or range parts of about ``rows / 4096``.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_group"))
    rows = stored(rows.withColumn("k", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text_crc32", "size")), spark)
    rows = rows.withColumn("part", F.shiftrightunsigned("k", 52))
    tie = ("doc_id", "text_crc32", "size")
    # rank within the source
    of_source = Window.partitionBy("source")
    offsets = rows.groupBy("source", "part").agg(F.count("*").alias("n")).select(
        F.col("source").alias("s_"), F.col("part").alias("p_"), F.sum("n").over(of_source).alias("of"),
        (F.sum("n").over(of_source.orderBy("part")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("source", "part").orderBy(F.shiftleft("k", 12), "k", *tie)
    # sources of one size would fall on the same places; each starts at its own
    phase = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ranked = rows.withColumn("r", F.row_number().over(inner)).join(offsets, F.expr("source <=> s_ and part = p_"))
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "text_group", "k", ((F.col("before") + F.col("r") - 1 + phase) / F.col("of")).alias("at"))
    ranked = stored(ranked.withColumn("part", F.floor(F.col("at") * PARTS).cast("int")), spark)
    # place in the interleaved order of all rows
    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select(F.col("part").alias("p_"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("of"))
    inner = Window.partitionBy("part").orderBy("at", "k", F.col("source").asc_nulls_last(), *tie)
    placed = ranked.withColumn("r", F.row_number().over(inner)).join(offsets, F.expr("part = p_")).withColumn("place", F.col("before") + F.col("r") - 1)
    cut = placed.withColumn("shard", F.expr(f"cast(place * {int(shards)} div of as int)"))
    first = F.expr(f"(shard * of + {int(shards) - 1}) div {int(shards)}")
    return cut.select("doc_id", "source", "size", "text_crc32", "text_group", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), spark)
