"""Stored days as JSON documents, checked before anything of them is loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S


def _key_set(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))


def _missing(text: Column, wanted: tuple[str, ...]) -> Column:
    """The wanted keys that an object lacks, comma-joined; null if there are none."""
    return F.nullif(F.array_join(F.array_except(F.array(*map(F.lit, wanted)), _key_set(text)), ","), F.lit(""))


def _record_fault(record: Column, i: Column, ids: Column, day: Column) -> Column:
    get = lambda name: F.get_json_object(record, f"$.{name}")
    strings = lambda name: F.coalesce(F.from_json(get(name), "array<string>"), F.array().cast("array<string>"))
    missing = _missing(record, S.RECORD_KEYS)
    this = F.get(ids, i)
    strange = F.array_except(strings("source_query_membership"), F.array(*map(F.lit, S.SOURCE_VIEWS)))
    return (
        F.when(~record.startswith("{"), "an announcement is no object")
        .when(missing.isNotNull(), F.concat(F.lit("announcement lacks "), missing))
        .when(~F.coalesce(this.rlike("^0*[1-9][0-9]*$"), F.lit(False)), "bad submission_id")
        .when(F.array_position(ids, this) < i + 1, F.concat(F.lit("duplicate submission_id "), this))
        .when(~F.coalesce(get("source_audience").isin(*S.AUDIENCES), F.lit(False)), "bad source_audience")
        .when(~F.coalesce(get("status").isin("New", "Standing"), F.lit(False)), "bad status")
        .when(~F.array_contains(strings("distribution_dates"), day), F.concat(F.lit("the day isn't among the dates of "), this))
        .when(F.size(strange) > 0, F.concat(F.lit("unknown view "), F.get(strange, F.lit(0))))
    )


def checked(days: DataFrame, document: str) -> DataFrame:
    """``days`` with ``reject``: the first fault of each JSON document, null for a good one.

    A document is an object with all keys, of version 1, with a day of ten
    characters, a list of announcements, a registry that isn't empty (an empty day
    has one, too), and as many announcements as it counts.  Each announcement has
    its keys, a positive id that no earlier one has, a known audience, status and
    view, and the day among its dates.
    """
    text = F.trim(F.col(document))
    part = lambda name: F.get_json_object(text, f"$.{name}")
    records = F.from_json(part("announcements"), "array<string>")
    registry = part("category_registry")
    rows = days.withColumn("__records", records).withColumn("__ids", F.transform("__records", lambda r: F.get_json_object(r, "$.submission_id")))
    faults = F.transform("__records", lambda r, i: _record_fault(r, i, F.col("__ids"), part("target_date")))
    missing = _missing(text, S.ARTIFACT_KEYS)
    head = (
        F.when(~F.coalesce(text.startswith("{") & F.json_object_keys(text).isNotNull(), F.lit(False)), "no JSON object")
        .when(missing.isNotNull(), F.concat(F.lit("missing keys "), missing))
        .when(~F.coalesce(part("schema_version") == "1", F.lit(False)), "unsupported schema_version")
        .when(~F.coalesce(F.length(part("target_date")) == 10, F.lit(False)), "bad target_date")
        .when(~F.coalesce(part("announcements").startswith("["), F.lit(False)), "announcements is no list")
        .when(F.coalesce(registry, F.lit("")).isin("", "[]", "{}", "null", "0", "false"), "empty category registry")
        .when(~F.coalesce(part("counts.unique").try_cast("bigint") == F.size("__records"), F.lit(False)), "counts.unique isn't the number of announcements")
    )
    first = F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0))
    return rows.withColumn("reject", F.coalesce(head, first)).drop("__records", "__ids")
