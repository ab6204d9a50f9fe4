"""Raw announcements to normalised records, and what a day's collection says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking

PEOPLE = {"SubmittedBy": "submitted_by", "ApprovedBy": "approved_by", "Contact": "contact"}
PERSON = {"Name": "name", "Department": "department", "JobTitle": "job_title", "Email": "email", "Phone": "phone"}
LABELS = {"Both": "Everyone", "Employees": "Employees only", "Students": "Students only"}


def label(audience: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), audience), audience)


def body_metrics(page: Column) -> Column:
    """struct(body_bytes, image_count, data_uri_count, data_uri_bytes, link_count)."""
    page = F.coalesce(page, F.lit(""))
    uris = F.regexp_extract_all(page, F.lit(r"""(?i)src\s*=\s*["'](data:[^"']*)"""), 1)
    return F.struct(
        F.octet_length(page).cast("bigint").alias("body_bytes"), F.regexp_count(page, F.lit(r"(?i)<img\b")).alias("image_count"), F.size(uris).alias("data_uri_count"),
        F.aggregate(uris, F.lit(0).cast("bigint"), lambda n, u: n + F.octet_length(u)).alias("data_uri_bytes"), F.size(T.links(page)).alias("link_count"),
    )


def normalised(raw: DataFrame, target: Column) -> DataFrame:
    """The allowed columns only, sentinels and blanks as null, dates distinct and sorted, status of the target day.

    Everything that isn't named here is left behind, so private fields of the
    source can't reach a table.
    """
    s = lambda c: F.col(f"Submission.{c}")
    blank = lambda c: T.blank_to_null(s(c))
    dates = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("DistributionDates.List", F.array().cast("array<string>")), T.date_or_null), lambda d: d.isNotNull())))
    rows = raw.withColumn("distribution_dates", dates)
    event = F.coalesce(s("Event"), F.lit(False))
    return rows.select(
        s("Id").try_cast("bigint").alias("submission_id"), blank("Title").alias("title"), blank("Audience").alias("source_audience"), s("Category").alias("category_id"), blank("SubmittedStatus").alias("submitted_status"),
        *[blank(f"{who}{'RowanEmail' if who == 'Contact' and what == 'Email' else what}").alias(f"{name}_{field}") for who, name in PEOPLE.items() for what, field in PERSON.items()], blank("UpdatedByName").alias("updated_by_name"),
        s("SubmittedDate").try_cast("timestamp").alias("submitted_date"), s("ApprovedDate").try_cast("timestamp").alias("approved_date"), s("UpdatedDate").try_cast("timestamp").alias("updated_date"),
        event.alias("is_event"), F.when(event, blank("EventName")).alias("event_name"), T.date_or_null(s("EventDate")).alias("event_date"), T.minutes_or_null(s("EventStartTime")).alias("event_start_min"),
        T.minutes_or_null(s("EventEndTime")).alias("event_end_min"), blank("EventLocation").alias("event_location"), F.coalesce(s("EventNoEnd"), F.lit(False)).alias("event_no_end"),
        F.coalesce(s("ExtraEdition"), F.lit(False)).alias("extra_edition"), F.col("FullBody").alias("full_body"), F.col("ShortBody").alias("short_body"), T.html_to_text("FullBody").alias("body_text"),
        "distribution_dates", F.array_min("distribution_dates").alias("first_distribution_date"), ranking.status(F.col("distribution_dates"), target).alias("status"), label(blank("Audience")).alias("audience_label"),
        F.struct(F.col("Category.Id").alias("id"), F.col("Category.Title").alias("title"), F.col("Category.Rank").alias("rank"), F.col("Category.Is_Active").alias("is_active"), F.col("Category.RestrictSubmitting").alias("restrict_submitting"), F.col("Category.Color").alias("color"), F.col("Category.ApprovalProcess").alias("approval_process")).alias("category"),
        body_metrics(F.col("FullBody")).alias("body_diagnostics"), "source_view",
    )


def merged_views(records: DataFrame, order: list[str]) -> DataFrame:
    """One row for each id: the record of the first view in ``order``, and all views that it is in."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source_view"))
    rest = [c for c in records.columns if c not in ("submission_id", "source_view")]
    out = records.groupBy("submission_id").agg(F.min_by(F.struct(*rest), place).alias("r"), F.array_sort(F.collect_set("source_view")).alias("views"))
    return out.select("submission_id", "r.*", "views")


def day_summary(records: DataFrame) -> DataFrame:
    """One row: unique, new, standing and per-audience counters; zeros for an empty day."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    only = lambda v: (F.size("views") == 1) & F.array_contains("views", F.lit(v))
    return records.agg(
        F.count("*").alias("unique"), n(F.col("status") == "New").alias("new"), n(F.col("status") == "Standing").alias("standing"), n(only("Employees")).alias("employee_only"),
        n(only("Students")).alias("student_only"), n(F.size("views") > 1).alias("everyone"), F.countDistinct("category_id").alias("categories"),
    )
