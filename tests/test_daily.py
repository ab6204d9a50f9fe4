import base64
import datetime as dt
import json
import os
import urllib.parse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from noticeflow.functions import payloads
from noticeflow.operators import enrichment, mention_ladder, recheck, run_windows, venues
from noticeflow.sources import generations


# ---- enrichment ----


def steps():
    def poison(k):
        if k == 3:
            raise RuntimeError("bad " * 100)
        return None if k is None else k * 10

    return [
        enrichment.Step("a", enrichment.guarded(poison, LongType(), "k"), withheld=F.when(F.col("k") == 5, "no event")),
        enrichment.Step("b", F.try_divide(F.lit(100), F.col("a")), fault=F.when(F.col("a") == 0, "division")),
        enrichment.Step("c", F.col("b") + F.col("a")),
    ]


def test_a_poisoned_row_costs_itself_only(spark):
    rows = spark.createDataFrame([(k, "x") for k in (0, 1, 2, 3, 4, 5, None)], "k long, state string")
    big = enrichment.guarded(lambda k: k, LongType(), "k")
    assert [r.x.value for r in spark.createDataFrame([(2**53 + 1,), (None,)], "k long").select(big.alias("x")).collect()] == [2**53 + 1, None]
    got = {r.k: r for r in enrichment.enriched(rows, steps()).collect()}
    assert {k: (r.state, r.step) for k, r in got.items()} == {0: ("failed", "b"), 1: ("done", None), 2: ("done", None), 3: ("failed", "a"), 4: ("done", None), 5: ("withheld", "a"), None: ("done", None)}
    assert got[3].reason == ("RuntimeError: " + ("bad " * 100)[:160]) and (got[3].b, got[3].c, got[0].c, got[5].a) == (None, None, None, None)
    assert (got[1].c, got[4].c) == (20.0, 42.5)


def test_the_audit_adds_up_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(k % 7,) for k in range(100)], "k long").withColumn("id", F.monotonically_increasing_id())
    out, counts = enrichment.observed(enrichment.enriched(rows, steps()))
    out.write.parquet(f"{tmp_path}/out")
    assert counts.get["rows"] == 100 == counts.get["done"] + counts.get["withheld"] + counts.get["failed"]
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert enrichment.counters(kept).agg(F.sum("n")).first()[0] == 100 and enrichment.audit(kept, "id").select("id").distinct().count() == 100
    assert enrichment.enriched(rows.limit(0), steps()).count() == 0


# ---- generations ----


def published(spark, path, *values):
    return [generations.publish(spark.createDataFrame([(v, None)], "a long, b string"), path) for v in values]


def data_file(path, name):
    return next(os.path.join(path, name, f) for f in os.listdir(os.path.join(path, name)) if f.endswith(".parquet"))


def value(snapshot):
    return [r.a for r in snapshot.rows.collect()]


def test_the_last_good_generation_is_read_and_the_reason_told(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(generations.SnapshotError, match="there is none"):
        generations.read(spark, path)
    names = published(spark, path, 1, 2, 3, 4)
    found = generations.read(spark, path)
    assert (value(found), found.generation, found.passed_over) == ([4], names[3], [])

    with open(data_file(path, names[3]), "r+b") as f:  # a torn write
        f.truncate(40)
    found = generations.read(spark, path)
    assert value(found) == [3] and "files" in found.passed_over[0] and names[3] in found.passed_over[0]

    os.remove(f"{path}/{names[2]}/{generations.MANIFEST}")  # its writer died before the manifest
    found = generations.read(spark, path)
    assert value(found) == [2] and len(found.passed_over) == 2 and "manifest" in found.passed_over[1]

    with pytest.raises(generations.SnapshotError, match="schema"):
        generations.read(spark, path, spark.createDataFrame([], "a long, c string").schema)
    with pytest.raises(generations.SnapshotError, match="more than 10"):
        generations.read(spark, path, most_bytes=10)


def test_versions_digests_and_pointers(spark, tmp_path):
    path = str(tmp_path)
    names = published(spark, path, 1, 2)
    note = f"{path}/{names[1]}/{generations.MANIFEST}"
    manifest = json.load(open(note))
    json.dump({**manifest, "schema_version": 99}, open(note, "w"))
    os.path.exists(c := f"{path}/{names[1]}/.{generations.MANIFEST}.crc") and os.remove(c)
    found = generations.read(spark, path)
    assert value(found) == [1] and "version" in found.passed_over[0]
    json.dump({**manifest, "digest": "0:0:0"}, open(note, "w"))
    assert value(generations.read(spark, path)) == [2] and value(generations.read(spark, path, deep=True)) == [1]
    open(note, "w").write("{torn")
    assert value(generations.read(spark, path)) == [1]
    json.dump(manifest, open(note, "w"))

    for torn in ("", "g0000", "x" * (generations.MOST_NOTE_BYTES + 1)):
        open(f"{path}/{generations.POINTER}", "w").write(torn)
        os.path.exists(c := f"{path}/.{generations.POINTER}.crc") and os.remove(c)
        found = generations.read(spark, path)
        assert value(found) == [2] and found.passed_over[0].startswith("pointer")


def test_an_unpublished_generation_is_not_read(spark, tmp_path):
    names = published(spark, str(tmp_path), 1)
    newer = spark.createDataFrame([(9, None)], "a long, b string")
    newer.write.parquet(f"{tmp_path}/g00000002-abc")  # died before its manifest and the pointer
    found = generations.read(spark, str(tmp_path))
    assert value(found) == [1] and found.generation == names[0] and not found.passed_over
    assert published(spark, str(tmp_path), 3)[0].startswith("g00000003") and value(generations.read(spark, str(tmp_path))) == [3]


# ---- mentions ----


def test_every_rung_and_refusal(spark):
    place = "alias string, place_id string, campus string, confidence string, latitude double, longitude double, description string, garage boolean"
    catalogue = spark.createDataFrame([
        ("a", "A", "n", "high", 1.0, 2.0, "d", False), ("b", "B1", "n", "high", 1.0, 2.0, "d", False), ("b", "B2", "s", "high", 1.0, 2.0, "d", False), ("c", "C", "n", "low", 1.0, 2.0, "d", False),
        ("d", "D", "s", "medium", None, None, "d", False), ("e", "E", "n", "high", 1.0, 2.0, "", False), ("g", "G", "n", "low", 1.0, 2.0, "d", True), ("g2", "G", "n", "low", 1.0, 2.0, "d", True), ("h", "H", "x", "high", 1.0, 2.0, "d", True), ("i", "I", "x", "high", 1.0, 2.0, "d", True),
    ], place)
    refreshed = spark.createDataFrame([("r", "R", "n", "high", 1.0, 2.0, "d", False), ("a", "Z", "n", "high", 1.0, 2.0, "d", False)], place)
    m = "mention_id int, lookup_keys array<string>, bare boolean, weak boolean, hint string"
    rows = [
        (1, ["none", "a"], False, False, None), (2, ["b"], False, False, "s"), (3, ["b"], False, False, "other"), (4, ["c"], False, False, None), (5, ["d"], False, False, None), (6, ["e"], False, False, None),
        (7, ["r"], False, True, None), (8, ["?"], False, True, "n"), (9, ["?"], False, False, "n"), (10, ["?"], False, None, None), (11, [], True, False, "n"), (12, [], True, False, "x"), (13, [], True, False, None), (14, ["a"], False, False, "s"),
    ]
    links = spark.createDataFrame([("n", "N"), (None, "ALL")], "campus string, url string")
    got = {r.mention_id: (r.outcome, r.method, r.place_id, r.url if r.url in ("N", "ALL", None) else "place") for r in mention_ladder.callouts(spark.createDataFrame(rows, m), catalogue, refreshed, links).collect()}
    assert got == {
        1: ("resolved", "catalogue", "A", "place"), 2: ("resolved", "catalogue", "B2", "place"), 3: ("ambiguous", None, None, "ALL"), 4: ("low_confidence", None, None, "N"), 5: ("incomplete", None, None, "ALL"),
        6: ("incomplete", None, None, "N"), 7: ("resolved", "refresh", "R", "place"), 8: ("ignored", None, None, None), 9: ("unknown", None, None, "N"), 10: ("unknown", None, None, "ALL"),
        11: ("resolved", "sole_garage", "G", "place"), 12: ("ambiguous", None, None, None), 13: ("ambiguous", None, None, None), 14: ("resolved", "catalogue", "A", "place"),
    }
    assert mention_ladder.callouts(spark.createDataFrame([], m), catalogue, refreshed, links).count() == 0


# ---- run windows ----


def test_windows_on_the_days_when_clocks_change(spark):
    ny, rows = "America/New_York", []
    cases = [
        ("2026-03-08 06:59:00", ny, 2, 30, "2026-03-07 07:30:00"),  # before the gap
        ("2026-03-08 07:00:00", ny, 2, 30, "2026-03-08 07:30:00"),  # 3:00 on the wall: 2:30 has passed, and stands for 3:30
        ("2026-03-08 10:29:00", ny, 6, 30, "2026-03-07 11:30:00"), ("2026-03-08 10:30:00", ny, 6, 30, "2026-03-08 10:30:00"),
        ("2026-11-01 05:29:00", ny, 1, 30, "2026-10-31 05:30:00"), ("2026-11-01 05:30:00", ny, 1, 30, "2026-11-01 05:30:00"), ("2026-11-01 06:30:00", ny, 1, 30, "2026-11-01 05:30:00"),
        ("2026-11-01 11:30:00", ny, 6, 30, "2026-11-01 11:30:00"), ("2026-11-01 11:29:00", ny, 6, 30, "2026-10-31 10:30:00"),
        ("2026-06-01 00:00:00", "Nowhere/Else", 6, 30, None), ("2026-06-01 00:00:00", None, 6, 30, None), ("2026-06-01 00:00:00", ny, 24, 0, None), ("2026-06-01 00:00:00", ny, 6, None, None), (None, ny, 6, 30, None),
    ]
    rows = [(i, *c[:4]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, now string, zone string, h int, m int").withColumn("now", F.col("now").cast("timestamp"))
    got = df.withColumn("w", run_windows.window_start(F.col("now"), F.col("zone"), F.col("h"), F.col("m"))).orderBy("k").select(F.col("w").cast("string")).collect()
    assert [r[0] for r in got] == [c[4] for c in cases]
    t = lambda x: F.lit(x).cast("timestamp")
    three = spark.range(1).select(run_windows.staleness(t("2026-01-01"), t("2026-01-01")), run_windows.staleness(t("2025-12-31"), t("2026-01-01")), run_windows.staleness(t(None), t("2026-01-01")), run_windows.staleness(t("2026-01-01"), t(None)))
    assert tuple(three.first()) == ("fresh", "stale", "unknown", "unknown")


def test_component_states(spark):
    seen = [None, "ok", None, "error", None, "error", "error", None, "ok", None, "error"]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(seen)] + [("d", 0, "error")], "c string, at int, seen string")
    got = [r.state for r in run_windows.component_states(df, "c", "at", "seen").orderBy("c", "at").collect()]
    assert got == ["unknown", "ok", "unknown", "degraded", "degraded", "degraded", "failed", "failed", "ok", "unknown", "degraded", "degraded"]


# ---- data addresses ----


def test_percent_decoding_equals_the_standard_library(spark):
    texts = ["", "a+b", "%41%4a%4A", "100%", "%", "%%41", "%4", "%zz%41", "é%C3%A9 ", "%00%ff", "a%2", "%2525", "日本%E6"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", payloads.percent_decoded(F.col("t")).alias("b")).orderBy("k").collect()
    assert [bytes(r.b) for r in got] == [urllib.parse.unquote_to_bytes(t) for t in texts]


def test_data_bytes(spark):
    b = base64.b64encode(b"some bytes").decode()
    cases = {f"data:image/png;base64,{b}": b"some bytes", f" data:image/png;charset=x;BASE64, {b[:5]} \n {b[5:]} ": b"some bytes", "data:,a%20+b%": b"a +b%", "data:text/plain,%41": b"A", "data:;base64,": b"", "data:;base64,!!!": None, "data:;base64,A": None, "data:;base64,QQ": b"A", "http://x": None, "data:no comma": None, None: None}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "k int, t string").select("k", payloads.data_bytes(F.col("t")).alias("b")).orderBy("k").collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == list(cases.values())
    page = """<img src="data:,a'b"><img alt=x SRC = ' data:image/gif;base64,QUJD '><img src=x><img src="http://x/data:,y">"""
    found = spark.createDataFrame([(page,), (None,)], "p string").select(F.transform(payloads.data_addresses(F.col("p")), payloads.data_bytes).alias("x")).collect()
    assert [[bytes(b) for b in r.x] for r in found] == [[b"a'b", b"ABC"], []]


# ---- venues ----


def test_fragments(spark):
    cases = {
        "Oak Student Center, Elm Ballroom": ["Oak Student Center, Elm Ballroom", "Oak Student Center, Elm", "Oak Student Center", "Elm Ballroom"],
        "Elm Hall - Room 221": ["Elm Hall - Room 221", "Elm Hall -".strip(" -"), "Room 221"],
        "Alpha-Beta Hall 3rd Floor Lounge": ["Alpha-Beta Hall 3rd Floor Lounge", "Alpha-Beta Hall"],
        "Room 5": ["Room 5"], "  ": [], None: [], "--": [], "Rm. 12b, Savitz": ["Rm. 12b, Savitz", "Rm. 12b", "Savitz"],
    }
    got = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "k int, v string").select("k", venues.fragments(F.col("v")).alias("f")).orderBy("k").collect()
    assert [r.f for r in got] == list(cases.values())


def test_cache_states_and_the_ladder(spark):
    d = lambda n: dt.date(2026, 1, n)
    cache = spark.createDataFrame([
        ("elm hall", "Elm", "n", 1.0, 2.0, 5, "f", d(1)), ("elm hall", "Elm", "n", 1.5, 2.0, 7, "f", d(20)), ("oak hall", "Oak", "n", 3.0, 4.0, 9, "old", d(9)), ("ash hall", "Ash", "n", None, None, 9, "f", d(9)), ("", "?", "n", 1.0, 1.0, 1, "f", d(1)),
    ], "key string, name string, campus string, latitude double, longitude double, minutes int, fingerprint string, verified date")
    place = "name string, campus string, latitude double, longitude double"
    landmarks = spark.createDataFrame([("Ash Hall", "n", 10.0, 0.0), ("Big Student Center", "s", 11.0, 0.0), ("Twin Hall", "n", 12.0, 0.0), ("Twin Hall", "s", 13.0, 0.0), ("North Twin Hall", "n", 14.0, 0.0)], place)
    facilities = spark.createDataFrame([("Lot A1", "n", 20.0, 0.0), ("Twin Hall", "n", 21.0, 0.0)], place)
    rows = spark.createDataFrame([
        (1, "Elm  Hall!", None, d(10)), (2, "Elm Hall", None, d(25)), (3, "Elm Hall", None, dt.date(2025, 12, 1)), (4, "OAK HALL", None, d(10)), (5, "Ash Hall, Room 3", None, d(10)), (6, "Student Center; Lobby", None, d(10)),
        (7, "Twin Hall", "s", d(10)), (8, "Twin Hall", None, d(10)), (9, "Lot A1", None, d(10)), (10, None, None, d(10)), (11, "Elm Hall", None, dt.date(2026, 9, 1)), (12, "Nowhere at all", "n", d(10)),
    ], "id int, venue string, hint string, day date")
    got = {r.id: (r.state, r.source, r.latitude, r.minutes) for r in venues.looked_up(rows, cache, landmarks, facilities, F.lit("f")).collect()}
    assert got == {
        1: ("hit", "cache", 1.0, 5), 2: ("hit", "cache", 1.5, 7), 3: ("miss", None, None, None), 4: ("stale", "cache", 3.0, None), 5: ("miss", "landmark", 10.0, None), 6: ("miss", "landmark", 11.0, None),
        7: ("miss", "landmark", 13.0, None), 8: ("miss", "facility", 21.0, None), 9: ("miss", "facility", 20.0, None), 10: ("none", None, None, None), 11: ("stale", "cache", 1.5, None), 12: ("miss", None, None, None),
    }
    assert recheck.as_known(rows.limit(0).withColumn("key", F.lit("x")), cache, "key", "day", "verified", ["name"]).count() == 0


def test_of_entries_verified_on_one_day_the_larger_counts_by_value(spark):
    day = dt.date(2026, 1, 1)
    entry = lambda key, latitude, minutes, mark="f": (key, key, "c", latitude, 0.0, minutes, mark, day)
    cache = spark.createDataFrame(
        [entry("a", 9.0, 1), entry("a", 10.0, 2), entry("a", -11.0, 3), entry("b", 5.0, 9), entry("b", 5.0, 10), entry("c", 99.0, 5), entry("c", None, 1), entry("d", 5.0, 60), entry("d", 5.0, None)],
        "key string, name string, campus string, latitude double, longitude double, minutes int, fingerprint string, verified date",
    )
    rows = spark.createDataFrame([(k, k, None, day) for k in "abcd"], "id string, venue string, hint string, day date")
    none = spark.createDataFrame([], "name string, campus string, latitude double, longitude double")
    got = {r.id: (r.state, r.latitude, r.minutes) for r in venues.looked_up(rows, cache, none, none, F.lit("f")).collect()}
    assert got == {"a": ("hit", 10.0, 2), "b": ("hit", 5.0, 10), "c": ("miss", None, None), "d": ("stale", 5.0, None)}
    tagged = spark.createDataFrame([(1, 1, {"x": "1"}), (1, 1, {"x": "2"})], "k int, seen int, tags map<string,string>")
    assert recheck.as_known(spark.createDataFrame([(1, 2)], "k int, at int"), tagged, "k", "at", "seen", ["tags"]).first()["known_tags"] == {"x": "2"}
