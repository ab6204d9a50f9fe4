import datetime as dt

from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.operators import digest, history, places, quality, ranking, repeats, timeline

BODY = "The library will close early on Friday because the heating system needs repair and staff will move the reading room to the second floor of the annex building"


def notices(spark, rows):
    cols = "submission_id long, title string, body_text string, full_body string, category_id long, source_audience string, is_event boolean, event_date date, event_start_min int, contact_email string, submitted_by_email string"
    base = {"title": "Library Hours", "body_text": BODY, "full_body": "<a href='http://x/'>x</a>", "category_id": 1, "source_audience": "Both", "is_event": False, "event_date": None, "event_start_min": None, "contact_email": "c@x", "submitted_by_email": "s@x"}
    return spark.createDataFrame([tuple({"submission_id": i, **base, **r}.values()) for i, r in rows], cols)


def test_repeats(spark):
    prior = notices(spark, [(1, {}), (2, {}), (3, {"category_id": None}), (4, {"title": "Other"})])
    current = notices(spark, [
        (10, {}), (11, {"body_text": BODY.replace("Friday", "Fridays")}), (12, {"category_id": 2}), (13, {"category_id": None}), (14, {"source_audience": "Students"}), (15, {"body_text": BODY + " and the cafe opens late"}),
        (16, {"body_text": "Something else entirely, " * 8}), (17, {"is_event": True}), (18, {"title": "LIBRARY—hours!", "submitted_by_email": "z@x"}), (19, {"body_text": BODY.replace("second", "third"), "submitted_by_email": "z@x"}),
    ])
    got = {r.submission_id: r for r in repeats.find_repeats(current, prior).collect()}
    assert {i: (r.matched_submission_id, r.materially_changed) for i, r in got.items() if i != 11} == {10: (1, False), 13: (3, False), 15: (1, True), 18: (1, False)}
    assert got[10].method == "identical" and got[15].method == "changed" and got[11].matched_submission_id == 1 and not got[11].materially_changed
    assert got[10].confidence == 0.99 and got[15].confidence == 0.80


def test_versions_and_merges(spark):
    obs = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "A", 3), (2, "A", 1)], "id int, digest string, at int")
    got = sorted((r.id, r.digest, r.version, r.changed) for r in history.versions(obs, "id", "digest", "at", "at").collect())
    assert got == [(1, "A", 1, False), (1, "B", 2, True), (2, "A", 1, False)]  # a return to A is no version
    fresh = history.new_versions(obs, spark.createDataFrame([(1, "A", 9), (1, "C", 9), (3, "A", 9)], obs.schema), "id", "digest")
    assert sorted((r.id, r.digest, r.changed) for r in fresh.collect()) == [(1, "C", True), (3, "A", False)]
    a, b = (spark.createDataFrame(x, "id int, first int, n int") for x in ([(1, 5, None), (2, 7, 1)], [(1, 3, 2), (3, 9, 4)]))
    merged = history.merge_snapshot(a, b, ["id"], {"first": history.smallest, "n": history.added})
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 3, 2), (2, 7, 1), (3, 9, 4)]
    assert sorted((tuple(r) for r in history.append_only(a, b, ["id"]).collect()), key=repr) == [(1, 5, None), (2, 7, 1), (3, 9, 4)]


def test_offers_and_best_candidates(spark):
    rows = spark.createDataFrame([(1, 0.9, True), (2, 0.9, False), (3, 0.1, True), (4, 0.7, True)], "id int, score double, built boolean").withColumn("g", F.lit(1))
    assert [r.id for r in ranking.offered(rows, ["g"], ["id"], most=2).orderBy("id").collect()] == [1, 4]
    assert ranking.best_candidate(rows, "g", "score", "id").first().id == 1


def test_relevance_is_bounded_and_ordered(spark):
    rows = spark.createDataFrame([(0, "Town Hall with the President", "budget policy"), (1, "Trivia and karaoke bingo game night", "giveaway"), (2, "Notes", "x"), (3, None, None), (4, "Swim lesson", "x")], "i int, t string, b string")
    got = [r.s for r in ranking.with_relevance(rows, F.col("t"), F.col("b"), F.lit("Both"), F.lit("Official"), "s").orderBy("i").collect()]
    assert [round(x, 4) for x in got] == [1.0 if 0.3 + 0.4 + 0.15 + 0.3 > 1 else 1.15, 0.1, 0.75, 0.75, 0.35]


def test_repeats_respect_days_delivery_and_status(spark):
    dated = lambda d: f"{BODY} on {d} and all of the usual rules of the house stay as they were before in every room"
    prior = notices(spark, [(1, {"body_text": dated("September 3")}), (2, {"title": "Other"}), (5, {"title": "Never sent"})])
    current = notices(spark, [(10, {"body_text": dated("September 4")}), (11, {"body_text": dated("September 3") + " too"}), (12, {"title": "Other"}), (13, {"title": "Never sent"}), (14, {"title": "Other"})]).withColumn("source_status", F.when(F.col("submission_id") == 14, "Standing").otherwise("New"))
    delivered = spark.createDataFrame([(1,), (2,)], "submission_id long")
    got = {r.submission_id: r.matched_submission_id for r in repeats.find_repeats(current, prior, delivered).collect()}
    assert got == {11: 1, 12: 2}


def test_copies_of_a_title_are_compared_once_and_none_is_lost(spark):
    import random

    from noticeflow.functions import text as T

    r = random.Random(3)
    words = BODY.split()
    bodies = [" ".join(w if r.random() > k / 60 else r.choice(words) for w in words * (1 + k % 2)) for k in range(12)]
    rows = [(i, {"body_text": bodies[i % 12]}) for i in range(60)]
    df = notices(spark, rows)
    got = {x.submission_id: (x.matched_submission_id, round(x.similarity, 6)) for x in repeats.find_repeats(df, df).collect()}
    folded = {x.submission_id: (x.body_key, x.own_words, x.days) for x in repeats.prepared(df).collect()}
    for i in range(60):
        best = None
        for j in range(60):
            if i != j:
                s = T.similarity(folded[i][0], folded[j][0])
                if s >= 0.97 or s >= 0.85 and len(set(folded[j][1]) - set(folded[i][1])) <= 2:
                    best = max(best, (s, -j)) if best else (s, -j)
        assert got.get(i) == (None if best is None else (-best[1], round(best[0], 6)))


def test_gates_fail_on_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, "t", "b", "Approved", 1), (2, "Both", ["2026-01-01"], "t", "b", None, None)], "submission_id long, source_audience string, d array<string>, title string, full_body string, submitted_status string, category_id long")
    rows = rows.withColumn("distribution_dates", F.col("d").cast("array<date>"))
    got = {r.rule: r.detail for r in quality.announcement_gates(rows, spark.createDataFrame([(1,)], "id long"), 2, "2026-01-01", "Students", 100).collect()}
    assert got == {"V2 complete": 0, "V3 whole": 0, "V4 audience": 1, "V5 date": 1, "V6 unique": 0, "V6 positive": 0, "V7 required": 1, "V7 approved": 1, "V7 category": 1}


def test_needles_of_any_length_are_found_in_names(spark):
    names = spark.createDataFrame([(1, "north maple hall annex"), (2, "maple hallway"), (3, " ".join(f"w{i}" for i in range(12)))], "id int, name string")
    needles = spark.createDataFrame([("maple hall",), ("hall",), (" ".join(f"w{i}" for i in range(2, 12)),)], "needle string")
    assert sorted((r.id, r.needle[:6]) for r in digest.contained(needles, names, "needle", "name").collect()) == [(1, "maple "), (3, "w2 w3 ")]
    # a needle beyond eight words is compared whole; spaces don't count; nothing meets nulls and empty tables
    names = spark.createDataFrame([(1, " a1 b2 c3 d4 e5  f6 g7 h8 i9 "), (2, "a1 b2 c3 d4 e5 f6 g7 h8 x"), (3, None), (4, ""), (5, "g7 h8 i9"), (5, "g7 h8 i9")], "id int, name string")
    needles = spark.createDataFrame([("a1 b2 c3 d4 e5 f6 g7 h8 i9",), ("g7  h8 i9",), (None,), ("       ",)], "needle string")
    assert sorted((r.id, r.needle[:2]) for r in digest.contained(needles, names, "needle", "name").collect()) == [(1, "a1"), (1, "g7"), (5, "g7"), (5, "g7")]
    assert digest.contained(needles.limit(0), names, "needle", "name").count() == 0 and digest.contained(needles, names.limit(0), "needle", "name").count() == 0


def test_pinned_fields_stay(spark):
    old = spark.createDataFrame([("a", "A", "seen", ["name"]), ("b", "B", "x", []), ("c", "C", "x", [])], "place_id string, name string, text string, override_fields array<string>")
    new = spark.createDataFrame([("a", "AA", "new"), ("b", "B", "x"), ("d", "D", "x")], "place_id string, name string, text string")
    got = {r.place_id: (r.name, r.text, r.outcome) for r in places.upserted(old, new).collect()}
    assert got == {"a": ("A", "new", "updated"), "b": ("B", "x", "unchanged"), "c": ("C", "x", "absent"), "d": ("D", "x", "inserted")}


def test_severity_and_staleness(spark):
    rows = spark.createDataFrame([(["ok", "failed"],), (["ok"],), ([],), (["ok", None],)], "s array<string>")
    assert [r.x for r in rows.select(timeline.severity(F.col("s")).alias("x")).collect()] == ["failed", "ok", "unknown", "unknown"]
    r = spark.range(1).select(timeline.stale(F.lit(dt.date(2025, 1, 1)), F.lit(dt.date(2026, 1, 1))).alias("a"), timeline.stale(F.lit(None).cast("date"), F.lit(dt.date(2026, 1, 1))).alias("b")).first()
    assert r.a is True and r.b is None


def test_nearest_finds_all_within_the_radius(spark):
    import math
    import random

    r = random.Random(5)
    at = [("n0", 39.7499, -75.12), ("n1", 39.7501, -75.12)] + [(f"p{i}", 39.75 + r.uniform(-0.01, 0.01), -75.12 + r.uniform(-0.01, 0.01)) for i in range(120)]
    at += [(f"q{i}", -60.05 + r.uniform(-0.01, 0.01), 179.9 + r.uniform(-0.02, 0.02)) for i in range(60)]
    rows = spark.createDataFrame([("a", *x) for x in at], "campus string, name string, lat double, lon double")
    got = {(x.place, x.landmark) for x in places.nearest(rows, rows, most=1000, within=400.0).collect()}
    metres = lambda a, b: 111320.0 * math.hypot((b[2] - a[2]) * math.cos(math.radians(a[1])), b[1] - a[1])
    want = {(a[0], b[0]) for a in at for b in at if a != b and metres(a, b) <= 400}
    assert got == want and ("n0", "n1") in got and len(want) > 500


def test_campus_of_nulls_and_ties(spark):
    dim = lambda rows: spark.createDataFrame(rows, "name string, campus string")
    rows = [(1, None, None), (2, "A", "Near Maple Hall."), (3, None, "MAPLE-hall, and maple hall"), (4, None, "Maple Hallway"), (5, None, "Maple Hall and the quay"), (6, None, "Maple Hall, Alder Annex, quay"), (None, "A", "quay"), (7, None, "")]
    data = spark.createDataFrame(rows, "id int, category string, body string")
    categories = dim([("A", "south")]).withColumnRenamed("name", "category")
    names, keywords = dim([("Maple Hall", "north"), ("maple hall", "north"), ("alder annex", "south"), ("quay", "north")]), dim([("Quay", "south"), (None, "north")])
    got = {r[0]: (r[1], r[2]) for r in places.campus_of(data, categories, names, keywords, "id", "body", "category").collect()}
    assert got == {
        1: (None, "none"), 2: ("south", "category"), 3: ("north", "building"), 4: (None, "none"), 5: ("north", "building"), 6: ("south", "keyword"), None: ("south", "category"), 7: (None, "none"),
    }
    assert places.campus_of(data.limit(0), categories, names, keywords, "id", "body", "category").count() == 0


def test_description_fault(spark):
    good = "Just north of Maple Hall, beside the tennis courts."
    rows = [(None, ["Maple Hall"]), (good, ["Maple Hall"]), (good, None), (good.replace("north", "beautifully north"), ["Maple Hall"]), ("  ", []), ("Next to Lot 7 and the amazing big hall", []), ("word " * 30, []), ("word " * 31, [])]
    got = spark.createDataFrame(rows, "said string, names array<string>").select(T.description_fault(F.col("said"), F.col("names"))).collect()
    assert [r[0] for r in got] == ["empty", None, "unknown name", None, "empty", "praise", None, "length"]


def test_faults_of_sessions_without_fields(spark):
    df = spark.createDataFrame(
        [(1, 1, None, None, None, None, None, None, None), (2, 1, "t", None, 10, 20, "b?x", None, None), (3, 1, "t", None, 10, 20, "b?x<", None, None), (4, 1, "t", None, 10, None, "b?x", None, None), (5, 1, "t", None, 10, 20, None, None, None),
         (6, 1, "t", None, 10, 20, "b?x", "BEGIN:VCALENDAR\nEND:VCALENDAR", None), (7, 1, "t", None, 10, 20, "b?x", None, "x.txt"), (8, 1, "t", None, 10, 20, "b?x", None, None), (8, 2, "t", None, 10, 20, "b?x", None, None)],
        "notice int, session int, title string, event_date date, start_min int, end_min int, link string, document string, file_name string",
    )
    got = sorted((r.notice, r.session, r.fault) for r in quality.session_faults(df, "notice", "b").collect())
    assert got == [(1, 1, "title"), (2, 1, None), (3, 1, "character"), (4, 1, "end"), (5, 1, "address"), (6, 1, "document"), (7, 1, None), (8, 1, "start"), (8, 2, "start")]
    assert quality.session_faults(df.limit(0), "notice", "b").count() == 0


def test_bounds_of_similarity_lose_no_match():
    import difflib
    import random

    from noticeflow.functions import text as T

    r = random.Random(9)
    for _ in range(150):
        a = [r.choice("abcdefgh     etaoin") for _ in range(r.randrange(20, 400))]
        b = list(a)
        for _ in range(r.randrange(60)):
            k = r.randrange(len(b))
            b[k : k + r.randrange(3)] = [r.choice("abcdefgh ") for _ in range(r.randrange(3))]
            b = b or ["x"]
        a, b = "".join(a), "".join(b)
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert 2 * T.common_length(a, b) / (len(a) + len(b)) >= ratio - 1e-12
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
            got = T.similarity(a, b, 0.85)
            assert got == ratio if ratio >= 0.85 else got < 0.85 or got == ratio
    assert (T.common_length("", "abc"), T.common_length("abcbdab", "bdcaba"), T.common_length("aaaa", "aa")) == (0, 4, 2)


def test_matched_length_is_that_of_the_library_and_no_pair_is_lost():
    import difflib
    import random

    from noticeflow.functions import likeness

    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshr") if r.random() < 0.9 else r.choice("zqxjkvbpéß日") for _ in range(r.randrange(2, 9)))
    for size in (5, 20, 34, 60, 150) * 3:
        base = list(" ".join(word() for _ in range(size)) if size % 20 else (chr(0x4E00 + r.randrange(400)) for _ in range(300)))
        texts = ["".join(base), "".join(base[:60]) + " ".join(word() for _ in range(40))]
        for _ in range(5):
            text = list(base)
            for _ in range(r.randrange(25)):
                k = r.randrange(len(text) + 1)
                text[k : k + r.randrange(40 if r.random() < 0.2 else 3)] = [r.choice("etaoin zqx") for _ in range(r.randrange(4))]
            texts.append("".join(text) or "x")
        places = [likeness.Places(t) for t in texts]
        forth, back = likeness.can_match(places, 0.85, 0.8)
        some = likeness.can_match(places, 0.85, 0.8, 3)
        assert (some[0] == forth[:3, 3:]).all() and (some[1] == back[:3, 3:]).all()
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                if a != b:
                    ratio, total = difflib.SequenceMatcher(None, a, b).ratio(), len(a) + len(b)
                    assert 2.0 * likeness.matched_length(places[i], places[j]) / total == ratio
                    bound = 2.0 * likeness.matched_length(places[i], places[j], 0.85) / total
                    assert bound == ratio if ratio >= 0.85 else 0.85 > bound >= ratio - 1e-12
                    assert ratio < 0.85 or min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or forth[i, j] and back[j, i]


def test_bodies_go_to_units_of_bounded_size_not_to_pairs(spark, monkeypatch):
    """300 bodies of one title: each is sent a few times, each pair of near lengths meets in one unit, and parts find what one unit finds."""
    import random

    r = random.Random(11)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    bodies = []
    for k in range(300):
        own = bodies[r.randrange(k)].split() if k and k % 6 == 0 else r.choices(words, k=r.randrange(30, 120))
        if k % 6 == 0:
            own[k % len(own)] = "changed"
        bodies.append(" ".join(own))
    df = notices(spark, [(k, {"body_text": b}) for k, b in enumerate(bodies)])
    whole = sorted(map(tuple, repeats.find_repeats(df, df).collect()))
    assert len(whole) >= 10
    monkeypatch.setattr(repeats, "UNIT_CLASSES", 20)
    units = {}
    for u in repeats._units(repeats._classes(df)[1]).collect():
        units.setdefault(u.unit, []).append((u.side, u["class"]))
    assert len(units) > 10 and max(map(len, units.values())) <= 80 and sum(map(len, units.values())) < 15 * 300
    length = {x["class"]: x.body_chars for x in repeats._classes(df)[1].collect()}
    met = [frozenset((a, b)) for own in units.values() for s, a in own for t, b in own if a < b and (s == t == -1 or s != t)]
    assert len(met) == len(set(met)) and {frozenset((a, b)) for a in length for b in length if a < b and min(length[a], length[b]) >= 0.8 * max(length[a], length[b])} <= set(met)
    assert sorted(map(tuple, repeats.find_repeats(df, df).collect())) == whole
    # two tables meet as one does
    again = df.withColumn("submission_id", F.col("submission_id") + 1000)
    assert {x.submission_id - 1000 for x in repeats.find_repeats(again, df.filter("submission_id % 2 = 0")).collect()} >= {k for k in range(0, 300, 2)}
