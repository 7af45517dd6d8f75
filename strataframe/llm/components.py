"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import dropped, stored


def connected_components(edges: DataFrame, spark: SparkSession, most_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs to ``(id, component_id)``: the smallest id reachable, for every id in an edge.

    Each round is two joins against a per-node minimum, which combines before the shuffle, so a hub costs
    one row for each task; the tables are stored, so rounds never recompute one another. Self-links and nulls
    are left out; repeated and mirrored links count once; no edges give no rows.
    """
    now = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), spark)
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), spark)
        dropped(now, spark)
        was, now, mark = mark, after, _mark(after)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the links: equal for two rounds only when nothing moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
