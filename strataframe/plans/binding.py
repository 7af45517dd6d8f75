"""The driver's tables bound to the engine's record model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year_label(day: Column) -> Column:
    """Financial year, April to March, as ``YYYY-YY``."""
    start = F.when(F.month(day) >= 4, F.year(day)).otherwise(F.year(day) - 1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and region of each customer; the two small tables are under Spark's broadcast limit by their own size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).join(region, F.expr("n_regionkey = r_regionkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a line item: the region is the subsidiary, the nation the mine."""
    o = table(spark, sf_dir, "orders").join(places(spark, sf_dir), F.expr("o_custkey = c_custkey")).select("o_orderkey", "o_orderdate", "n_name", "r_name", "c_mktsegment")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return li.join(o, F.expr("l_orderkey = o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), F.col("l_orderkey").alias("row_index"),
        F.col("r_name").alias("subsidiary"), F.col("n_name").alias("mine"), F.col("c_mktsegment").alias("coalfield"), F.col("r_name").alias("state"),
        F.col("l_returnflag").alias("grade"), F.col("l_linestatus").alias("coal_type"), F.col("l_linestatus").alias("status"), year_label(F.col("o_orderdate")).alias("financial_year"),
        F.col("l_quantity").alias("production"), (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("target"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("dispatch"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 2)).alias("is_error"), (F.col("l_quantity") < 3).alias("is_warning"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record an order, whose key is unique: for ids, pages and ranks."""
    o = table(spark, sf_dir, "orders").join(places(spark, sf_dir), F.expr("o_custkey = c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").alias("row_index"), F.col("r_name").alias("subsidiary"), F.col("n_name").alias("mine"), F.col("c_mktsegment").alias("coalfield"), F.col("r_name").alias("state"),
        F.col("o_orderpriority").alias("grade"), F.col("o_orderstatus").alias("status"), year_label(F.col("o_orderdate")).alias("financial_year"), F.col("o_totalprice").alias("production"),
        (F.col("o_totalprice") * 0.5).alias("target"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("dispatch"),
        (F.col("o_totalprice") < 1000).alias("is_error"), (F.col("o_totalprice") < 5000).alias("is_warning"),
        F.lit(None).cast("string").alias("block"), F.lit(None).cast("string").alias("project"), F.col("o_orderpriority").alias("seam"))


def mines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place a supplier."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return s.select(F.col("s_suppkey").alias("mine_id"), F.col("s_name").alias("mine_name"), F.col("n_name").alias("state"), F.col("r_name").alias("subsidiary"), F.col("n_name").alias("coalfield"), F.col("s_acctbal").alias("production"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells of many shapes, made from orders: (record_id, field, value)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("long")
    year = F.year("o_orderdate")
    value = (
        F.when(k % 8 == 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
        .when(k % 8 == 1, F.concat(F.floor(price / 1000).cast("string"), F.lit(","), F.lpad((price % 1000).cast("string"), 3, "0")))
        .when(k % 8 == 2, F.concat(F.lit("FY"), year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")))
        .when(k % 8 == 3, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(k % 8 == 4, F.concat((price % 100).cast("string"), F.lit(" %")))
        .when(k % 8 == 5, F.concat(price.cast("string"), F.lit(" mt")))
        .when(k % 8 == 6, F.concat(F.lit("+"), price.cast("string")))
        .otherwise(F.concat(F.lit("-"), price.cast("string")))
    )
    field = F.when(k % 3 == 0, "production").when(k % 3 == 1, "remarks").otherwise("latitude")
    return o.select(k.alias("record_id"), field.alias("field"), value.alias("value"))


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value rows, made from orders: a label, a value with grouping commas, and the year of some rows."""
    o = order_records(spark, sf_dir)
    k, v = F.col("record_id"), F.floor("production").cast("long")
    label = F.element_at(F.array(*map(F.lit, ("Total Production", "Production Target", "Dispatch (MT)", "Remarks", "Coal Production"))), (k % 5 + 1).cast("int"))
    value = F.when(v >= 1000, F.concat(F.floor(v / 1000).cast("string"), F.lit(","), F.lpad((v % 1000).cast("string"), 3, "0"))).otherwise(v.cast("string"))
    return o.select("record_id", "row_index", (k % 50).alias("dataset_id"), "subsidiary", "mine", label.alias("label"), value.alias("value"), F.when(k % 3 == 0, F.col("financial_year")).alias("financial_year"))
