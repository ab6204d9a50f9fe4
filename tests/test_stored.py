import json

from pyspark.sql import functions as F

from noticeflow.operators import upserts
from noticeflow.sources import artifacts

VENUE = "normalized_venue string, display_name string, campus string, outbound_minutes int, travel_mode string, first_seen_at string, last_verified_at string"


def test_a_failed_lookup_takes_no_travel_away(spark):
    old = spark.createDataFrame([("a", "A", "n", 5, "walk", "1", "1"), ("b", "B", None, None, None, "1", "1"), ("only", "O", "n", 1, "walk", "1", "1")], VENUE)
    new = spark.createDataFrame([("a", None, "s", None, "drive", "2", "2"), ("b", "B2", "s", 9, None, "2", "2"), ("new", "N", None, None, "drive", "2", "2")], VENUE)
    got = {r[0]: tuple(r)[1:] for r in upserts.upserted(old, new, ["normalized_venue"], {k: v for k, v in upserts.VENUE_RULES.items() if k in old.columns}).collect()}
    assert got == {"a": ("A", "s", 5, "walk", "1", "2"), "b": ("B2", "s", 9, None, "1", "2"), "only": ("O", "n", 1, "walk", "1", "1"), "new": ("N", None, None, "drive", "2", "2")}


def test_the_last_of_several_new_rows_counts_and_null_keys_meet(spark):
    kind = "campus string, normalized_name string, name string, latitude double"
    old = spark.createDataFrame([(None, "a", "old", 1.0), ("n", "b", "old", 2.0)], kind)
    new = spark.createDataFrame([(None, "a", "x", None, 2), (None, "a", "y", 9.0, 1), ("n", "", "z", 1.0, 3), ("s", "b", "w", None, 1)], kind + ", seq int")
    got = sorted(map(tuple, upserts.landmarks(old, new, "seq").collect()), key=str)
    assert got == sorted([(None, "a", "x", None), ("n", "b", "old", 2.0), ("s", "b", "w", None)], key=str)
    assert upserts.landmarks(old.limit(0), new.limit(0), "seq").count() == 0


def test_priorities_by_hand_stay(spark):
    own = spark.createDataFrame([(1, 5, None), (2, None, 3), (3, None, None), (4, None, 8)], "category_id int, manual_priority int, inferred_priority int")
    found = spark.createDataFrame([(1, 9), (2, 9), (3, None), (99, 1)], "category_id int, priority int")
    assert sorted(map(tuple, upserts.inferred_priorities(own, found).collect()), key=str) == [(1, 5, None), (2, None, 9), (3, None, None), (4, None, 8)]


def record(**more):
    base = {"submission_id": 1, "title": "t", "source_audience": "Both", "status": "New", "full_body": "<p>[{", "distribution_dates": ["2026-01-01"], "first_distribution_date": "x", "source_query_membership": ["Students"]}
    return {k: v for k, v in {**base, **more}.items() if v != "gone"}


def day(*records, **more):
    base = {"schema_version": 1, "target_date": "2026-01-01", "counts": {"unique": len(records)}, "source_counts": {}, "category_registry": [{"Id": 1}], "announcements": list(records), "validation": {}}
    return json.dumps({k: v for k, v in {**base, **more}.items() if v != "gone"})


def test_faults_of_stored_days(spark):
    cases = {
        day(record()): None, day(): None, day(record(), record(submission_id="2", source_query_membership=None)): None, " " + day(record(full_body=None)) + "\n": None,
        "": "no JSON object", "[1]": "no JSON object", "{torn": "no JSON object", None: "no JSON object", day(counts="gone", validation="gone"): "missing keys counts,validation",
        day(schema_version=2): "unsupported schema_version", day(target_date="2026-1-1"): "bad target_date", day(target_date=None): "bad target_date", day(announcements={}): "announcements is no list",
        day(category_registry=[]): "empty category registry", day(category_registry=None): "empty category registry", day(record(), counts={"unique": 2}): "counts.unique isn't the number of announcements", day(record(), counts=None): "counts.unique isn't the number of announcements",
        day(record(), 5): "an announcement is no object", day(record(title="gone", status="gone")): "announcement lacks title,status", day(record(submission_id=0)): "bad submission_id", day(record(submission_id="x")): "bad submission_id", day(record(submission_id=None)): "bad submission_id",
        day(record(), record(submission_id="1")): "duplicate submission_id 1", day(record(source_audience="All")): "bad source_audience", day(record(status=None)): "bad status", day(record(distribution_dates=[])): "the day isn't among the dates of 1",
        day(record(distribution_dates=None)): "the day isn't among the dates of 1", day(record(source_query_membership=["Students", "X"])): "unknown view X", day(record(status="Old"), record(submission_id=0)): "bad status",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "k int, doc string")
    got = [r.reject for r in artifacts.checked(df, "doc").orderBy("k").collect()]
    assert dict(zip(cases, got, strict=True)) == cases
    assert artifacts.checked(df.limit(0), "doc").filter(F.col("reject").isNull()).count() == 0
