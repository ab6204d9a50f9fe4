"""Versioned history: content versions, snapshot merges, sticky facts, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]

#: Rules of a merge, of the old and the new value.
incoming: Rule = lambda old, new: new
preserve: Rule = lambda old, new: F.coalesce(old, new)
latest_known: Rule = lambda old, new: F.coalesce(new, old)
smallest: Rule = lambda old, new: F.least(old, new)
largest: Rule = lambda old, new: F.greatest(old, new)
added: Rule = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def merge_snapshot(existing: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule]) -> DataFrame:
    """The table after an upsert: rules say what happens where both sides have a row.

    Rows on one side only stay as they are.  One equi-join on the keys, null-safe.
    """
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    has = lambda side: F.col(f"{side}.__in").isNotNull()
    joined = existing.withColumn("__in", F.lit(1)).alias("e").join(new.withColumn("__in", F.lit(1)).alias("n"), on, "full_outer")
    pick = lambda c: F.when(has("e") & has("n"), rules.get(c, incoming)(F.col(f"e.{c}"), F.col(f"n.{c}"))).when(has("n"), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}"))
    return joined.select(*[F.coalesce(f"e.{k}", f"n.{k}").alias(k) for k in keys], *[pick(c).alias(c) for c in existing.columns if c not in keys])


def versions(observations: DataFrame, key: str, digest: str, at: str, tie: str) -> DataFrame:
    """One row for each content of a key that was seen, at its first sight.

    A return to an earlier content is no new version.  ``changed`` holds for
    all but a key's first.
    """
    first = Window.partitionBy(key, digest).orderBy(at, tie)
    seen = observations.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    order = Window.partitionBy(key).orderBy(at, tie)
    return seen.withColumn("version", F.row_number().over(order)).withColumn("changed", F.col("version") > 1)


def new_versions(existing: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``new`` whose content is unseen for the key, and whether the key was known."""
    known = existing.select(key).distinct().withColumn("changed", F.lit(True))
    fresh = new.join(existing.select(key, digest).distinct(), [key, digest], "left_anti").dropDuplicates([key, digest])
    return fresh.join(known, key, "left").select(*new.columns, F.coalesce("changed", F.lit(False)).alias("changed"))


def sticky(facts: DataFrame, key: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """Once the flag holds for a key it holds for all later rows."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return facts.withColumn(name, F.max(flag.cast("int")).over(w))


def append_only(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the row that was there first stays."""
    both = existing.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("__side")
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__side", "__n")


def first_owner(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def retained(rows: DataFrame, group: list[str], newest_first: list[Column], keep: int, recent: Column) -> DataFrame:
    """The newest ``keep`` rows of each group and all recent ones."""
    w = Window.partitionBy(*group).orderBy(*newest_first)
    return rows.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") <= keep) | recent).drop("__n")


def delivered_history(daily: DataFrame, deliveries: DataFrame, before) -> DataFrame:
    """First, last and number of delivered days of each id before a date."""
    sent = deliveries.filter("state = 'sent'").select("target_date").distinct()
    past = daily.filter(F.col("target_date") < F.lit(before)) if before is not None else daily
    return past.join(sent, "target_date", "left_semi").groupBy("submission_id").agg(
        F.min("target_date").alias("first_delivered_date"), F.max("target_date").alias("last_delivered_date"), F.countDistinct("target_date").alias("delivered_days"),
    )


def appearances(daily: DataFrame, deliveries: DataFrame) -> DataFrame:
    """``daily`` with the number of earlier days of each id, and of those the delivered ones.

    One window over the id instead of a correlated count; counted before any filter on the date.
    """
    sent = deliveries.filter("state = 'sent'").select("target_date").distinct().withColumn("__sent", F.lit(1))
    w = Window.partitionBy("submission_id").orderBy("target_date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = daily.join(sent, "target_date", "left")
    return rows.select(*daily.columns, (F.row_number().over(w) - 1).cast("bigint").alias("prior_appearances"), F.coalesce(F.sum("__sent").over(before), F.lit(0)).cast("bigint").alias("previous_deliveries"))
