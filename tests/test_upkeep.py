import datetime as dt
import functools
import operator
import random

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import groups, recheck
from noticeflow.sources import stores

DAY, NEXT = dt.date(2026, 3, 1), dt.date(2026, 3, 2)
SCHEMA = "target_date date, submission_id long, display_status string, changed boolean"


def stored(spark, path):
    rows = [(DAY, 1, "New", False), (DAY, 2, None, None), (DAY, 3, "Standing", True), (NEXT, 1, "New", False)]
    stores.replace_days(spark.createDataFrame(rows, SCHEMA), path, "target_date")
    return rows


def resolve(rows):
    return rows.selectExpr("target_date", "submission_id", "CASE WHEN submission_id < 3 THEN 'Standing' ELSE display_status END AS display_status", "changed")


def run(spark, path, **more):
    found, seen = recheck.recheck(spark, f"{path}/daily", f"{path}/audit", "2026-03-01", resolve, ["target_date", "submission_id"], ["display_status", "changed"], "late fix", "2026-03-05 10:00:00", **more)
    return sorted(tuple(r) for r in found.collect()), seen


def audit(spark, path):
    return sorted((r.submission_id, r.field, r.previous, r.current, r.n) for r in spark.read.parquet(f"{path}/audit").collect())


def test_a_dry_run_and_apply_find_the_same_and_a_second_apply_nothing(spark, tmp_path):
    rows = stored(spark, f"{tmp_path}/daily")
    want = [(DAY, 1, "display_status", "New", "Standing"), (DAY, 2, "display_status", None, "Standing")]
    dry, seen = run(spark, tmp_path)
    assert dry == want and not stores.exists(spark, f"{tmp_path}/audit")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/daily").select("target_date", "submission_id", "display_status", "changed").collect()), key=str) == sorted(rows, key=str)
    assert run(spark, tmp_path, apply=True, expected=seen)[0] == want
    assert audit(spark, tmp_path) == [(1, "display_status", "New", "Standing", 1), (2, "display_status", None, "Standing", 1)]
    assert run(spark, tmp_path, apply=True)[0] == [] and len(audit(spark, tmp_path)) == 2
    after = {(r.target_date, r.submission_id): (r.display_status, r.changed) for r in spark.read.parquet(f"{tmp_path}/daily").collect()}
    assert after == {(DAY, 1): ("Standing", False), (DAY, 2): ("Standing", None), (DAY, 3): ("Standing", True), (NEXT, 1): ("New", False)}


def test_apply_refuses_a_day_that_changed_since(spark, tmp_path):
    stored(spark, f"{tmp_path}/daily")
    _, seen = run(spark, tmp_path)
    stores.replace_days(spark.createDataFrame([(DAY, 1, "New", True)], SCHEMA), f"{tmp_path}/daily", "target_date")
    with pytest.raises(recheck.ChangedMeanwhile):
        run(spark, tmp_path, apply=True, expected=seen)
    assert not stores.exists(spark, f"{tmp_path}/audit")


def test_a_run_that_died_after_the_audit_records_nothing_twice(spark, tmp_path):
    stored(spark, f"{tmp_path}/daily")
    keys = ["target_date", "submission_id"]
    old = spark.read.parquet(f"{tmp_path}/daily").filter("target_date = DATE '2026-03-01'")
    found = recheck.changes(old, resolve(old), keys, ["display_status", "changed"])
    assert recheck.record(spark, f"{tmp_path}/audit", found, keys, "late fix", "2026-03-05 10:00:00") == 2
    assert len(run(spark, tmp_path, apply=True)[0]) == 2 and len(audit(spark, tmp_path)) == 2


def test_there_and_back_are_corrections_of_their_own(spark, tmp_path):
    def once(a, b, at):
        df = lambda x: spark.createDataFrame([(1, x)], "k long, s string")
        return recheck.record(spark, f"{tmp_path}/audit", recheck.changes(df(a), df(b), ["k"], ["s"]), ["k"], "r", at)

    assert [once("A", "B", "2026-01-01"), once("A", "B", "2026-01-02"), once("B", None, "2026-01-03"), once(None, "B", "2026-01-04"), once("A", "B", "2026-01-05"), once("A", "A", "2026-01-06")] == [1, 0, 1, 1, 1, 0]
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/audit").collect()) == [1, 2, 3, 4]


def test_changes_are_null_safe_and_see_rows_of_one_side(spark):
    df = lambda rows: spark.createDataFrame(rows, "k string, a long, b string")
    got = recheck.changes(df([("x", 1, None), (None, 2, "b"), ("old", None, None)]), df([("x", None, None), (None, 2, "b"), ("new", 5, None)]), ["k"], ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [("new", "a", None, "5"), ("new", "row", None, "present"), ("old", "row", "present", None), ("x", "a", "1", None)]
    assert recheck.changes(df([]), df([]), ["k"], ["a"]).count() == 0


def test_fingerprints_of_hashes_beyond_a_long(spark):
    one = F.xxhash64(F.to_json(F.struct("a")))
    rows = spark.range(4000).select(F.col("id").alias("a")).withColumn("h", one).filter("h > 0")
    hashes = [r.h for r in rows.collect()]
    assert sum(h >> 8 for h in hashes) > 2**63
    assert recheck.fingerprint(rows.select("a")) == f"{len(hashes)}:{functools.reduce(operator.xor, hashes)}:{sum(h >> 8 for h in hashes)}"
    assert recheck.fingerprint(rows.select("a").limit(0)) == "0:None:None"


def test_only_what_was_known_then(spark):
    rows = spark.createDataFrame([(1, 5, "r"), (1, 9, "s"), (2, 5, "t"), (None, 5, "u")], "k long, day int, x string")
    versions = spark.createDataFrame([(1, 5, "a"), (1, 8, "b"), (1, 10, "c"), (1, 8, "bb"), (2, 6, "d"), (None, 1, "n")], "k long, seen int, title string")
    got = recheck.as_known(rows, versions, "k", "day", "seen", ["title"]).collect()
    assert sorted((r.x, r.known_title) for r in got) == [("r", "a"), ("s", "bb"), ("t", None), ("u", "n")]


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_components_equal_brute_force(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(1000, 1100)]
    star = [(5000, k) for k in range(5001, 5300)]
    for pairs in ([], [(1, 1)], [(None, 2), (3, 3), (4, 5), (5, 4)], [(r.randrange(300), r.randrange(300)) for _ in range(150)] + chain + star):
        df = spark.createDataFrame(pairs, "a long, b long")
        assert {x.member: x.root for x in groups.components(df, "a", "b").collect()} == brute(pairs)


PAIR = "submission_id long, matched_submission_id long, family_key string, method string, confidence double"
MEMBER = "family_id long, submission_id long, matched_submission_id long, content_hash string, confidence double, method string, first_seen date, last_seen date"


def backfill(spark, pairs, members, seen):
    content = spark.createDataFrame([(k, f"h{k}") for k in range(40) if k != 7], "submission_id long, content_hash string")
    found = groups.backfilled(spark.createDataFrame(pairs, PAIR), content, members, seen)
    families, rows, retired = (df.collect() for df in found)
    return {f.family_id: f for f in families}, {m.submission_id: m for m in rows}, {r.retired_id: r.family_id for r in retired}, spark.createDataFrame([tuple(r)[:-1] for r in rows], MEMBER)


def test_families_keep_their_ids(spark):
    first = [(12, 10, "a|1|Both", "identical", 0.99), (13, 12, "a|1|Both", "changed", 0.8), (22, 20, "b|1|Both", "identical", 0.99), (7, 5, "c|2|", "changed", 0.8)]
    families, members, retired, kept = backfill(spark, first, spark.createDataFrame([], MEMBER), "2026-01-01")
    assert {k: (f.canonical_submission_id, f.member_count, f.confidence, f.method) for k, f in families.items()} == {10: (10, 3, 0.99, "identical"), 20: (20, 2, 0.99, "identical"), 5: (5, 2, 0.8, "changed")}
    assert (members[12].matched_submission_id, members[10].matched_submission_id, members[7].content_hash, members[12].content_hash) == (10, None, None, "h12") and not retired
    assert [m for m in members if members[m].is_canonical] == [10, 20, 5] or {m for m in members if members[m].is_canonical} == {5, 10, 20}

    again = backfill(spark, first, kept, "2026-02-01")
    assert {m: (x.family_id, x.first_seen.month, x.last_seen.month) for m, x in again[1].items()} == {m: (x.family_id, 1, 2) for m, x in members.items()}
    assert again[0].keys() == families.keys() and not again[2]

    # an earlier member moves the canonical one, not the id; pairs that join two families keep the older id
    later = [(10, 3, "d|1|Both", "changed", 0.8), (20, 13, "e|1|Both", "changed", 0.8), (31, 30, "f|1|", "identical", 0.99)]
    families, members, retired, _ = backfill(spark, later, kept, "2026-03-01")
    assert {k: (f.canonical_submission_id, f.member_count) for k, f in families.items()} == {10: (3, 6), 5: (5, 2), 30: (30, 2)} and retired == {20: 10}
    assert (members[3].is_canonical, members[10].is_canonical, members[22].last_seen.month, members[22].family_id, members[5].confidence) == (True, False, 1, 10, 0.8)


def test_pairs_of_one_key_are_one_family_and_none_gives_none(spark):
    families, members, _, _ = backfill(spark, [(2, 1, "k||", "identical", 0.99), (9, 8, "k||", "changed", 0.8)], spark.createDataFrame([], MEMBER), "2026-01-01")
    assert {m: x.family_id for m, x in members.items()} == {1: 1, 2: 1, 8: 1, 9: 1} and families[1].member_count == 4
    assert backfill(spark, [], spark.createDataFrame([], MEMBER), "2026-01-01")[:3] == ({}, {}, {})
