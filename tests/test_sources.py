import json

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import normalise, quality
from noticeflow.sources import bulletins, placemarks, stores


def record(i, title, dates, audience="Both", category=1, **more):
    return {"FullBody": f"<p>{title}</p><img src='data:image/png;base64,AAAA'><a href='http://x'>x</a>", "ShortBody": "s", "DistributionDates": {"List": dates}, "Category": {"Id": category, "Title": "News", "Rank": 1},
            "Submission": {"Id": str(i), "Title": title, "Audience": audience, "Category": category, "Event": False, "EventDate": "1900-01-01", "EventStartTime": "00:00:00", "ApprovedByEmail": "secret@x.org"} | more}


CATEGORIES = [{"Id": 1, "Title": "News", "Rank": 1, "Count": "2"}, {"Id": 2, "Title": "Events", "Rank": 2, "Count": "0"}]


@pytest.fixture
def feed(tmp_path):
    first = [record(11, "One", ["2026-08-20", "2026-08-21"]), record(12, " ", ["2026-08-19", "2026-08-20", "bad"], "Employees", Event=True, EventName="Talk", EventDate="2026-09-01", EventStartTime="14:30:00")]
    (tmp_path / "a.json").write_text(json.dumps({"versionInfo": {}, "data": {"TotalCount": "2", "Categories": {"List": CATEGORIES}, "Announcements": {"List": first}}}))
    (tmp_path / "b.json").write_text(json.dumps({"TotalCount": "1", "Categories": CATEGORIES, "Announcements": [record(13, "Flat", ["2026-08-20"])]}))
    (tmp_path / "empty.json").write_text(json.dumps({"TotalCount": "0", "Categories": CATEGORIES, "Announcements": []}))
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "stale.json").write_text(json.dumps({"versionInfo": {"hasApiVersionChanged": True}, "data": {}}))
    (tmp_path / "failed.json").write_text(json.dumps({"exception": {"message": "down"}}))
    return str(tmp_path)


def test_both_forms_are_read_and_broken_files_set_aside(spark, feed):
    env = bulletins.read_envelopes(spark, feed)
    assert {r.file.rpartition("/")[2]: r.reject for r in bulletins.rejects(env).collect()} == {"broken.json": "malformed", "stale.json": "stale version", "failed.json": "exception: down"}
    rows = normalise.normalised(bulletins.announcements(env, "Employees"), F.lit("2026-08-20").cast("date"))
    assert not quality.forbidden_fields(rows.schema)
    got = {r.submission_id: r for r in rows.collect()}
    assert set(got) == {11, 12, 13} and got[12].title is None and got[12].status == "Standing" and got[11].status == "New"
    assert [str(d) for d in got[12].distribution_dates] == ["2026-08-19", "2026-08-20"] and got[12].event_start_min == 870 and got[11].event_date is None and got[11].event_start_min is None
    assert got[11].body_diagnostics.data_uri_count == 1 and got[11].body_diagnostics.link_count == 1 and got[11].body_text == "One\nx"
    registry = bulletins.categories(env)
    assert sorted((r.id, r["count"]) for r in registry.collect()) == [(1, 2), (2, 0)]
    gates = {(g.rule): g.ok for g in quality.announcement_gates(rows, registry, 3, "2026-08-20", "Employees").collect()}
    assert gates["V2 complete"] and gates["V5 date"] and not gates["V7 required"] and gates["V6 unique"]


def test_views_merge_in_order(spark, feed):
    env, day = bulletins.read_envelopes(spark, feed), F.lit("2026-08-20").cast("date")
    e = normalise.normalised(bulletins.announcements(env, "Employees"), day)
    s = normalise.normalised(bulletins.announcements(env, "Students").filter("Submission.Id != '12'"), day)
    both = normalise.merged_views(e.unionByName(s), ["Employees", "Students"])
    assert {r.submission_id: r.views for r in both.collect()} == {11: ["Employees", "Students"], 12: ["Employees"], 13: ["Employees", "Students"]}
    assert normalise.day_summary(both).first().asDict() == {"unique": 3, "new": 2, "standing": 1, "employee_only": 1, "student_only": 0, "everyone": 2, "categories": 1}
    assert normalise.day_summary(both.limit(0)).first()["new"] == 0


KML = """<?xml version="1.0"?><kml><Document><Folder><name>Visitor Parking</name>
<Placemark><name>Visitor Parking</name><description>Name: Lot O-1&lt;br&gt;x</description><Polygon><outerBoundaryIs><LinearRing><coordinates> 0,0,0 2,0,0 2,2,0 0,2,0 0,0,0 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark><name>Lot P</name><Point><coordinates>
 -75.1,39.7,0 </coordinates></Point></Placemark><Placemark><name>Lot bad</name><Point><coordinates>x,y</coordinates></Point></Placemark></Folder>
<Folder><name>Employee Parking</name><Placemark><name>Employee Parking</name><description>Name: Lot O-1</description><Point><coordinates>1,1</coordinates></Point></Placemark></Folder>
<Folder><name>Buildings</name><Placemark><name>Scott Hall</name><Point><coordinates>-75.12,39.78,0</coordinates></Point></Placemark></Folder>
<Folder><name>Sports</name><Placemark><name>Scott  Hall</name><Point><coordinates>-75.12,39.780001,0</coordinates></Point></Placemark></Folder></Document></kml>"""


def test_placemarks(spark, tmp_path):
    (tmp_path / "m.kml").write_text(KML)
    marks = placemarks.read_placemarks(spark, str(tmp_path)).cache()
    lots = {r.name: r for r in placemarks.parking(marks, F.lit("north"), {"visitor parking": "Visitor", "employee parking": "Employee"}).collect()}
    assert set(lots) == {"Lot O-1", "Lot P"} and lots["Lot O-1"].permit_class == "Mixed" and lots["Lot O-1"].place_id == "north:lot:o-1" and lots["Lot P"].permit_class == "Visitor"
    assert [(r.name, r.category) for r in placemarks.landmarks(marks, F.lit("north")).collect()] == [("Scott Hall", "Buildings")]


def test_days_are_replaced_and_snapshots_swapped(spark, tmp_path):
    path, snap = str(tmp_path / "days"), str(tmp_path / "snap")
    rows = lambda *x: spark.createDataFrame(list(x), "day string, id int, v string")
    stores.replace_days(rows(("a", 1, "x"), ("b", 1, "x")), path, "day")
    for _ in range(2):
        stores.replace_days(rows(("a", 2, "y")), path, "day")
    assert sorted((r.day, r.id) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]
    stores.swap_snapshot(rows(("a", 1, "x")), snap)
    stores.swap_snapshot(stores.read_snapshot(spark, snap).withColumn("id", F.col("id") + 1), snap)
    assert stores.read_snapshot(spark, snap).first().id == 2
    stores.write_json(rows(("a", 1, None)), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"day":"a","id":1,"v":null}'
