"""Feeds as streams: days ingested once however often they come, sessions of activity, sticky state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import stores


def parquet_feed(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    rows = spark.readStream.schema(schema)
    return (rows.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else rows).parquet(path)


def ingest_days(feed: DataFrame, target: str, checkpoint: str, day: str, key: list[str]) -> StreamingQuery:
    """Run over what is there and stop.  A batch replaces the days that it holds, joined with what they held before.

    Rows that came earlier stay, so a repeated batch or a repeated record
    changes nothing.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = batch.select(day).distinct()
        own = list(dict.fromkeys([day, *key]))
        rest = [c for c in batch.columns if c not in own]
        both = batch.withColumn("__side", F.lit(1))
        if stores.exists(spark, target):
            both = spark.read.schema(batch.schema).parquet(target).join(days, day, "left_semi").withColumn("__side", F.lit(0)).unionByName(both)
        both = both.groupBy(*own).agg(F.min_by(F.struct(*rest), "__side").alias("r")).select(*own, "r.*").select(*batch.columns)
        stores.replace_days(both.checkpoint(), target, day)

    return feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(rows: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str | None = "1 day") -> DataFrame:
    """user, session_start, session_end, n: bursts of a user's events with no pause of ``gap``; for streams and tables.

    On a stream a session is given out once no event can extend it any more:
    ``late`` is how long events may be overdue.
    """
    rows = rows.withWatermark(at, late) if rows.isStreaming and late else rows
    found = rows.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def day_windows(rows: DataFrame, at: str, kind: str, late: str | None = "1 day") -> DataFrame:
    """day, kind, n on a stream or a table."""
    rows = rows.withWatermark(at, late) if rows.isStreaming and late else rows
    return rows.groupBy(F.window(at, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), kind, "n")
