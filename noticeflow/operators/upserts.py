"""Upserts whose columns have rules of their own, each one join on the keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A column's value where both sides have the row, from the old and the new row.
Rule = Callable[[Column, Column, str], Column]

incoming: Rule = lambda old, new, c: new[c]
latest_known: Rule = lambda old, new, c: F.coalesce(new[c], old[c])
preserve: Rule = lambda old, new, c: F.coalesce(old[c], new[c])


def with_travel(old: Column, new: Column, c: str) -> Column:
    """The new value only where travel was worked out anew, so that a failed lookup never takes a good one away."""
    return F.when(new["outbound_minutes"].isNotNull(), new[c]).otherwise(old[c])


TRAVEL = ("travel_mode", "outbound_minutes", "return_minutes", "routing_source", "routing_fingerprint", "routing_estimated")
VENUE_RULES: dict[str, Rule] = {
    **dict.fromkeys(("display_name", "campus", "latitude", "longitude", "source", "source_detail", "distance_metres"), latest_known), **dict.fromkeys(TRAVEL, with_travel),
    "first_seen_at": preserve, "last_verified_at": incoming,
}
REPEAT_RULES: dict[str, Rule] = {"first_detected_at": preserve, "family_id": latest_known}


def upserted(existing: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule], order: str | None = None) -> DataFrame:
    """``existing`` after ``new``: rows of one side stay or come as they are, and of both sides each column follows its rule, else the new value counts.

    order: a column of ``new`` alone; of several new rows of a key the last one
    counts, and of those that come last together the one with the larger values.  Without it new keys are unique.  Null-safe on keys; one join.
    """
    columns = existing.columns
    if order is not None:
        last = F.max_by(F.struct(*columns), F.struct(order, *(c for c in columns if c not in keys)))
        new = new.groupBy(*keys).agg(last.alias("__x")).select("__x.*")
    pack = lambda df, side: df.select(F.struct(*columns).alias(side))
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    both = pack(existing, "old").join(pack(new, "new"), on, "full_outer")
    old, now = F.col("old"), F.col("new")
    value = lambda c: F.when(old.isNull(), now[c]).when(now.isNull(), old[c]).otherwise(now[c] if c in keys else rules.get(c, incoming)(old, now, c))
    return both.select(*(value(c).alias(c) for c in columns))


def venues(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The venue cache after lookups, one for each venue: what is known stays, travel changes only where it was worked out."""
    return upserted(existing, new, ["normalized_venue"], VENUE_RULES)


def repeat_matches(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of repeats: the newest counts, but for the first day and a known family."""
    return upserted(existing, new, ["submission_id"], REPEAT_RULES)


def landmarks(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Landmarks by campus and folded name, which isn't empty: the last one seen counts as a whole."""
    return upserted(existing, new.filter("normalized_name != ''"), ["campus", "normalized_name"], {}, order)


def inferred_priorities(categories: DataFrame, inferred: DataFrame) -> DataFrame:
    """Categories with the priorities estimated for them, never where one was set by hand; unknown categories add none."""
    found = inferred.select("category_id", F.col("priority").alias("__p")).groupBy("category_id").agg(F.max("__p").alias("__p"))
    rows = categories.join(found, "category_id", "left")
    value = F.when(F.col("manual_priority").isNull() & F.col("__p").isNotNull(), F.col("__p")).otherwise(F.col("inferred_priority"))
    return rows.select(*(value.alias(c) if c == "inferred_priority" else c for c in categories.columns))
