"""Bulletin envelopes as JSON files: one file for each fetched page or stored day.

A file holds the service's envelope or the flattened form of it; both give the
same columns.  Broken files don't stop a load: they become rejects with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """file, total, categories, announcements, reject: one row for each file; ``reject`` is null for good ones."""
    raw = spark.read.schema(S.ENVELOPE).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    total = F.coalesce("data.TotalCount", "TotalCount").try_cast("bigint")
    categories, records = F.coalesce("data.Categories.List", "Categories"), F.coalesce("data.Announcements.List", "Announcements")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), total.alias("total"), categories.alias("categories"), records.alias("announcements"), F.col("exception.message").alias("error"), F.coalesce("versionInfo.hasApiVersionChanged", F.lit(False)).alias("stale"), "_corrupt_record")
    reject = (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed")
        .when(F.col("stale"), "stale version")  # an empty answer to an old version isn't an empty day
        .when(F.col("error").isNotNull(), F.concat(F.lit("exception: "), F.col("error")))
        .when(F.coalesce(F.col("total") < 0, F.lit(True)), "no total")
        .when(F.coalesce(F.size("categories"), F.lit(0)) <= 0, "no registry")  # an empty day still has one
        .when(F.col("announcements").isNull(), "no list")
    )
    return rows.withColumn("reject", reject).drop("_corrupt_record", "error", "stale")


def accepted(envelopes: DataFrame) -> DataFrame:
    return envelopes.filter("reject IS NULL")


def rejects(envelopes: DataFrame) -> DataFrame:
    return envelopes.filter("reject IS NOT NULL").select("file", "reject")


def announcements(envelopes: DataFrame, view: str) -> DataFrame:
    """A row for each announcement with the view that it came from."""
    return accepted(envelopes).select("file", F.explode("announcements").alias("a")).select("file", F.lit(view).alias("source_view"), "a.*")


def categories(envelopes: DataFrame) -> DataFrame:
    """id, title, rank, color, count: the registry; the first file's row of an id stays."""
    rows = accepted(envelopes).select("file", F.posexplode("categories").alias("pos", "c"))
    first = rows.groupBy(F.col("c.Id").alias("id")).agg(F.min_by(F.struct("c.Title", "c.Rank", "c.Color", "c.Count"), F.struct("file", "pos")).alias("c"))
    return first.select("id", F.col("c.Title").alias("title"), F.col("c.Rank").alias("rank"), F.col("c.Color").alias("color"), F.col("c.Count").try_cast("bigint").alias("count"))


def newest_prior(days: DataFrame, day: str, target: Column) -> DataFrame:
    """The rows of the newest day before the target."""
    last = days.filter(F.col(day) < target).agg(F.max(day).alias(day))
    return days.join(F.broadcast(last), day, "left_semi")  # one row
