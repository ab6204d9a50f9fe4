"""Gates over a load.  Each returns (rule, scope, ok, detail) rows; none collects data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .. import settings as S


def gate(df: DataFrame, rule: str, bad: Column, scope: str = "all") -> DataFrame:
    """One row: whether no row is bad, and how many are."""
    n = F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return df.agg(n.alias("detail")).select(F.lit(rule).alias("rule"), F.lit(scope).alias("scope"), (F.col("detail") == 0).alias("ok"), "detail")


def gates(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cross_foot(parts: DataFrame, part_total: str, whole: DataFrame, whole_total: str, rule: str = "completeness") -> DataFrame:
    """The parts' sum against the stated total; one row on each side."""
    a = parts.agg(F.coalesce(F.sum(part_total), F.lit(0)).cast("bigint").alias("parts"))
    b = whole.agg(F.coalesce(F.sum(whole_total), F.lit(0)).cast("bigint").alias("total"))
    both = a.crossJoin(b)  # one row each
    return both.select(F.lit(rule).alias("rule"), F.lit("all").alias("scope"), (F.col("parts") == F.col("total")).alias("ok"), F.abs(F.col("parts") - F.col("total")).alias("detail"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, registry: DataFrame, column: str, registry_column: str) -> DataFrame:
    """Rows whose non-null reference the registry lacks."""
    known = registry.select(F.col(registry_column).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(known, column, "left_anti").select(*df.columns)


def label_parity(members: DataFrame, key: str, view: str, left: str, right: str) -> DataFrame:
    """Each key's label from the views that it is in: both, or one of them."""
    seen = members.groupBy(key).agg(F.max((F.col(view) == left).cast("int")).alias("l"), F.max((F.col(view) == right).cast("int")).alias("r"))
    return seen.select(key, F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, left).when(F.col("r") == 1, right).otherwise("none").alias("label"))


def permutation(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing, unexpected or repeated ids of a response that should be a permutation."""
    missing = expected.select(key).distinct().join(got, key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = got.select(key).distinct().join(expected, key, "left_anti").withColumn("problem", F.lit("unexpected"))
    twice = duplicates(got.select(key), key).select(key, F.lit("repeated").alias("problem"))
    return missing.select(key, "problem").unionByName(extra.select(key, "problem")).unionByName(twice)


def forbidden_fields(schema: StructType, names: tuple[str, ...] = S.FORBIDDEN_KEYS, at: str = "") -> list[str]:
    """Paths of forbidden fields anywhere in a schema; no job runs."""
    found = []
    for f in schema.fields:
        path, kind = f"{at}.{f.name}".lstrip("."), f.dataType
        if f.name in names:
            found.append(path)
        while isinstance(kind, ArrayType):
            kind = kind.elementType
        if isinstance(kind, StructType):
            found += forbidden_fields(kind, names, path)
    return found


def announcement_gates(records: DataFrame, categories: DataFrame, total: int, target_date: str, audience: str, page_size: int | None = None) -> DataFrame:
    """The gates of one audience's normalised records; what is null where a value is needed is bad."""
    known = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("known")).distinct()
    rows = records.join(known, "category_id", "left")
    count = records.agg(F.countDistinct("submission_id").alias("n"), F.count("*").alias("rows"))
    bad = lambda good: ~F.coalesce(good, F.lit(False))
    day = F.lit(target_date).cast("date")
    one = lambda rule, ok, detail: count.select(F.lit(rule).alias("rule"), F.lit(audience).alias("scope"), ok.alias("ok"), detail.cast("bigint").alias("detail"))
    parts = [
        one("V2 complete", F.col("n") == total, F.abs(F.col("n") - total)),
        gate(rows, "V4 audience", bad(F.col("source_audience").isin(audience, "Both")), audience),
        gate(rows, "V5 date", bad(F.array_contains("distribution_dates", day)), audience),
        gate(duplicates(records, "submission_id"), "V6 unique", F.lit(True), audience),
        gate(rows, "V6 positive", bad(F.col("submission_id") > 0), audience),
        gate(rows, "V7 required", bad((F.trim("title") != "") & (F.trim("full_body") != "") & (F.size("distribution_dates") > 0)), audience),
        gate(rows, "V7 approved", bad(F.col("submitted_status") == "Approved"), audience),
        gate(rows, "V7 category", F.col("known").isNull(), audience),
    ]
    if page_size is not None:  # one full page of a larger total is a cut list
        cut = (F.col("rows") == page_size) & F.lit(total > page_size)
        parts.insert(1, one("V3 whole", ~cut, F.when(cut, total - page_size).otherwise(0)))
    return gates(*parts)


def soft_warnings(records: DataFrame) -> DataFrame:
    """(submission_id, warning) of records that pass but lack something a reader would look for."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    event = F.coalesce("is_event", F.lit(False))
    found = F.array_compact(F.array(
        F.when(empty("contact_email"), "no contact email"), F.when(event & empty("event_name"), "event without a name"), F.when(event & F.col("event_date").isNull(), "event without a date"),
    ))
    return records.select("submission_id", F.explode(found).alias("warning"))


def rejected_records(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the rules' names in order; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return rows.withColumn("broken", broken).filter(F.size("broken") > 0)


def clean_payload(text: Column, names: tuple[str, ...] = S.FORBIDDEN_KEYS) -> Column:
    """No forbidden key, e-mail address or data URI in a JSON text."""
    keys = "|".join(names)
    return ~F.coalesce(text.rlike(rf'"(?:{keys})"\s*:') | text.rlike(S.EMAIL) | text.rlike("(?i)data:[a-z]+/"), F.lit(False))


def session_faults(rows: DataFrame, notice: str, base: str) -> DataFrame:
    """Sessions with their first fault, null for none: title, end, address, character, document, file, start (as another's of the notice), name (likewise).

    rows: title, event_date, start_min, end_min, link, document, file_name; a
    missing document or file name is no fault, and a file name's form counts only
    with a document.  A missing title, end, start or link is one.
    """
    c, own = F.col, F.coalesce("document", F.lit("BEGIN:VCALENDAR\r\nEND:VCALENDAR"))
    torn = ~own.startswith("BEGIN:VCALENDAR") | ~own.rlike(r"END:VCALENDAR\s*\z") | ~own.contains("\r\n") | own.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    named = c("document").isNotNull() & (F.coalesce("file_name", F.lit("")) != "")
    same = lambda *by: F.count("*").over(Window.partitionBy(notice, *by)) > 1
    fault = (
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title").when(~F.coalesce(c("end_min") > c("start_min"), F.lit(False)), "end").when(~F.coalesce(c("link").startswith(f"{base}?"), F.lit(False)), "address")
        .when(c("link").rlike('[\\n\\r "<>]'), "character").when(torn, "document").when(named & (c("file_name").rlike(r"[/\\]") | ~c("file_name").endswith(".ics")), "file")
        .when(same("event_date", "start_min"), "start").when((F.coalesce("file_name", F.lit("")) != "") & same("file_name"), "name")
    )
    return rows.withColumn("fault", fault)
