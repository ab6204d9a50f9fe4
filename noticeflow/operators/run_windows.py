"""Whether a scheduled run has come and gone without a newer snapshot, in local time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_start(now: Column, zone: Column, hour: Column, minute: Column) -> Column:
    """The instant of the last scheduled run at or before ``now``, by the wall clock of its zone; null if the schedule isn't valid.

    Today's run counts once the wall clock has reached it, else yesterday's.  On
    the days when clocks change, a run time that doesn't exist is moved on by the
    gap, and of one that comes twice the first counts.
    """
    valid = F.try_make_timestamp(F.lit(2000), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), zone).isNotNull() & hour.between(0, 23) & minute.between(0, 59)
    wall = F.from_utc_timestamp(now, zone)
    due = (hour * 60 + minute) <= (F.hour(wall) * 60 + F.minute(wall))
    day = F.when(due, F.to_date(wall)).otherwise(F.date_sub(F.to_date(wall), 1))
    at = F.try_make_timestamp(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0), zone)
    return F.when(F.coalesce(valid, F.lit(False)), at)


def staleness(generated: Column, since: Column) -> Column:
    """fresh, stale (a run was due after it was written) or unknown (the time or the schedule can't be told)."""
    return F.when(generated.isNull() | since.isNull(), "unknown").when(generated < since, "stale").otherwise("fresh")


def component_states(rows: DataFrame, component: str, at: str, observed: str, give_up: int = 3) -> DataFrame:
    """``rows`` with the state of each component after each observation: ok, degraded, failed or unknown.

    observed: ok, error, or null (not seen).  An error degrades, the ``give_up``-th
    in a row fails, one ok makes all well again; what isn't seen leaves a component
    that was well unknown, and one that wasn't as it was.  One window over each
    component's observations: errors count since its last ok.
    """
    w = Window.partitionBy(component).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__oks", F.count_if(F.col(observed) == "ok").over(w))
    since = Window.partitionBy(component, "__oks").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    errors = F.count_if(F.col(observed) == "error").over(since)
    rows = rows.withColumn("__errors", errors)
    state = F.when(F.col("__errors") >= give_up, "failed").when(F.col("__errors") > 0, "degraded").when(F.col(observed) == "ok", "ok").otherwise("unknown")
    return rows.withColumn("state", state).drop("__oks", "__errors")
