"""Past days looked at again: what was known then, what differs now, and corrections that say so once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import stores
from . import history


class ChangedMeanwhile(RuntimeError):
    """The day's rows are no longer those that were looked at."""


def as_known(rows: DataFrame, versions: DataFrame, key: str, at: str, seen: str, fields: list[str]) -> DataFrame:
    """``rows`` with the fields of the latest version that was seen at or before the row's own time; null where none was.

    One union and one window over the key in place of a range join; of
    versions seen at one time the one whose fields are larger counts, field by
    field by their values; null is larger than any value.
    """
    # maps have no order, so their text stands for them
    ties = [F.to_json(F.struct(f), {"ignoreNullFields": "false"}) if "map<" in kind else F.col(f) for f, kind in versions.select(*fields).dtypes]
    v = versions.select(key, F.col(seen).alias("__at"), F.lit(0).alias("__side"), F.struct(*fields).alias("__v"), *(t.alias(f"__tie{i}") for i, t in enumerate(ties)))
    r = rows.select(key, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"))
    w = Window.partitionBy(key).orderBy("__at", "__side", *(F.asc_nulls_last(f"__tie{i}") for i in range(len(ties)))).rowsBetween(Window.unboundedPreceding, 0)
    both = v.unionByName(r, allowMissingColumns=True).withColumn("__known", F.last("__v", True).over(w))
    return both.filter("__side = 1").select("__row.*", *(F.col(f"__known.{f}").alias(f"known_{f}") for f in fields))


def changes(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Each changed field of each key: keys, field, previous, current, as strings.

    Null-safe on keys and fields.  A key that only one side has is a change of
    the field ``row`` between null and ``present``, and of its fields that have a value.
    Keys are unique on both sides.
    """
    images = lambda df, side: df.select(*(F.col(k).alias(f"__{side}_{k}") for k in keys), F.struct(*(F.col(f).cast("string").alias(f) for f in fields), F.lit("present").alias("row")).alias(side))
    on = [F.col(f"__old_{k}").eqNullSafe(F.col(f"__new_{k}")) for k in keys]
    both = images(old, "old").join(images(new, "new"), on, "full_outer")
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"old.{f}").alias("previous"), F.col(f"new.{f}").alias("current")) for f in (*fields, "row")))
    changed = F.filter(each, lambda x: ~x["previous"].eqNullSafe(x["current"]))
    return both.select(*(F.coalesce(f"__old_{k}", f"__new_{k}").alias(k) for k in keys), F.inline(changed))


def unrecorded(found: DataFrame, recorded: DataFrame, keys: list[str], at: str = "corrected_at") -> DataFrame:
    """The changes that aren't each key's and field's last correction already, so that a rerun adds none.

    A change back, and there again, is three corrections.
    """
    last = recorded.groupBy(*keys, "field").agg(F.max_by(F.struct("previous", "current"), F.struct(at, "n")).alias("__last"))
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}")) for k in (*keys, "field")]
    same = F.col("f.previous").eqNullSafe(F.col("l.__last.previous")) & F.col("f.current").eqNullSafe(F.col("l.__last.current"))
    return found.alias("f").join(last.alias("l"), [*on, same], "left_anti")


def corrected(found: DataFrame, recorded: DataFrame, keys: list[str], reason: Column, at: Column) -> DataFrame:
    """The rows to append to an audit: changes that it lacks, with the reason, the time, and each one's number for its key and field."""
    fresh = unrecorded(found, recorded, keys)
    counts = recorded.groupBy(*keys, "field").agg(F.max("n").alias("__n"))
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "field")]
    numbered = fresh.alias("f").join(counts.alias("c"), on, "left")
    return numbered.select(*(F.col(f"f.{c}").alias(c) for c in (*keys, "field", "previous", "current")), (F.coalesce("c.__n", F.lit(0)) + 1).alias("n"), reason.alias("reason"), at.alias("corrected_at"))


def fingerprint(rows: DataFrame) -> str:
    """One value of a set of rows in any order; columns count by name.

    The hashes of many rows sum up to more than a long holds, so they are added as decimals.
    """
    one = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
    n, x, total = rows.agg(F.count("*"), F.bit_xor(one), F.sum(F.shiftright(one, 8).cast("decimal(28,0)"))).first()
    return f"{n}:{x}:{total}"


def record(spark: SparkSession, audit: str, found: DataFrame, keys: list[str], reason: str, at: str) -> int:
    """Append what the audit lacks; how many that were."""
    types = {f.name: f.dataType for f in found.schema.fields}
    empty = spark.createDataFrame([], "n int").select(*(F.lit(None).cast(types[k]).alias(k) for k in keys), *(F.lit(None).cast("string").alias(c) for c in ("field", "previous", "current")), "n", F.lit("").alias("reason"), F.lit(None).cast("timestamp").alias("corrected_at"))
    recorded = spark.read.schema(empty.schema).parquet(audit) if stores.exists(spark, audit) else empty
    fresh = stores.cut(corrected(found, recorded, keys, F.lit(reason), F.lit(at).cast("timestamp")).select(*empty.columns))
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(audit)
    return n


def recheck(
    spark: SparkSession, store: str, audit: str, day: str, resolve: Callable[[DataFrame], DataFrame], keys: list[str], fields: list[str], reason: str, at: str, apply: bool = False, expected: str | None = None,
    column: str = "target_date",
) -> tuple[DataFrame, str]:
    """The changes that resolving a stored day again would make, and the fingerprint of the rows that it looked at.

    A dry run reads only.  Applied, the changes go to the audit first and then
    the day's partition is swapped: a run that dies in between is run again,
    finds the same changes, records none twice and swaps.  ``expected``: the
    dry run's fingerprint; ChangedMeanwhile if the day is another by now.
    Applied twice, the second finds nothing and writes nothing.
    """
    stored = spark.read.parquet(store).filter(F.col(column) == F.lit(day).cast("date"))
    seen = fingerprint(stored)
    if expected is not None and seen != expected:
        raise ChangedMeanwhile(f"{day} has changed since it was looked at")
    fresh = stores.cut(resolve(stored).select(*stored.columns))
    found = stores.cut(changes(stored, fresh, keys, fields))
    if apply and not found.isEmpty():
        record(spark, audit, found, keys, reason, at)
        if fingerprint(spark.read.parquet(store).filter(F.col(column) == F.lit(day).cast("date"))) != seen:
            raise ChangedMeanwhile(f"{day} changed while it was resolved")
        stores.replace_days(fresh, store, column)
    return found, seen


def outcomes(daily: DataFrame, deliveries: DataFrame) -> DataFrame:
    """daily with the status that each day's row should show by what had been delivered before that day: New, or Standing."""
    rows = history.appearances(daily, deliveries)
    return rows.select(*daily.columns, F.when(F.col("previous_deliveries") > 0, "Standing").otherwise("New").alias("display_status"))

