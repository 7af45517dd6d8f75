"""Tables in the cluster's shared folder: a narrow intermediate is written once and read as often as a query needs it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Unset, a local master gets a temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation.

    The files go when the application ends.
    """
    path = f"{shared_dir(spark).rstrip('/')}/strataframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataframe_path = path
    return out


def dropped(df: DataFrame, spark: SparkSession) -> None:
    """Delete a table that ``stored`` wrote and nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df._strataframe_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
