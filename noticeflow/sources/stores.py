"""Tables on shared storage: days replaced as partitions, whole snapshots swapped, JSON out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_days(rows: DataFrame, path: str, day: str) -> None:
    """Write ``rows`` and replace the days that occur in them; other days stay.  Running it twice changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def swap_snapshot(rows: DataFrame, path: str) -> None:
    """Write a new generation beside the old ones and point to it last.

    ``rows`` may read the table that they replace.  A job that dies leaves the
    pointer on the old generation.
    """
    name = f"generation-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    rows.sparkSession.createDataFrame([(name,)], "name string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/pointers")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    name = spark.read.parquet(f"{path}/pointers").orderBy(F.desc("at"), F.desc("name")).first()["name"]
    return spark.read.parquet(f"{path}/{name}")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object for each row, empty fields included."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at the path yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; in local mode a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noticeflow-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` worked out once, by a checkpoint in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` worked out once, as a compressed table in the shared folder of which a reader takes the columns that it needs."""
    path = scratch_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
