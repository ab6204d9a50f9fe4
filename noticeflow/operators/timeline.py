"""Intervals, freshness and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S


def merged_phases(rows: DataFrame, key: list[str], start: str, end: str, gap_minutes: int = S.PHASE_GAP_MINUTES) -> DataFrame:
    """Intervals of a key joined where they touch, overlap or are near: one row for each island."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col(start) > reach + F.expr(f"INTERVAL {gap_minutes} MINUTES"))
    rows = rows.withColumn("__fresh", fresh.cast("int")).withColumn("island", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "island").agg(F.min(start).alias("phase_start"), F.max(end).alias("phase_end"), F.count("*").alias("n"))


def stale(last: Column, as_of: Column, days: int = S.STALE_DAYS) -> Column:
    """True, false, or null where nothing is known."""
    return F.when(last.isNotNull(), F.datediff(as_of, last) > days)


def day_counts(rows: DataFrame, day: Column, kinds: list[str], column: str) -> DataFrame:
    """A row for each day: all rows, distinct users, and one counter for each kind."""
    count = lambda k: F.coalesce(F.sum(F.when(F.col(column) == k, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(f"n_{k}")
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), *map(count, kinds))


def last_where(rows: DataFrame, condition: Column, order: Column, group: list[str]) -> DataFrame:
    """Each group's last row that meets the condition."""
    return rows.filter(condition).groupBy(*group).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in group]), order).alias("r")).select(*group, "r.*")


def compact_counters(text: Column) -> Column:
    """A JSON object with its numeric entries only, keys in order."""
    entries = F.map_entries(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: v.rlike(r"^-?[0-9]+(\.[0-9]+)?$")))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def severity(states: Column) -> Column:
    """The worst of an array of states; none is unknown."""
    order = F.array(*map(F.lit, ("ok", "unknown", "degraded", "failed")))
    return F.element_at(order, F.greatest(F.coalesce(F.array_max(F.transform(states, lambda s: F.array_position(order, F.coalesce(s, F.lit("unknown"))))), F.lit(2)), F.lit(1)).cast("int"))
