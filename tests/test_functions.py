import datetime as dt

from pyspark.sql import functions as F

from noticeflow.functions import calendar, geo, mentions, moments, sessions
from noticeflow.functions import text as T


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_sentinels(spark):
    r = one(
        spark, a=T.date_or_null(F.lit("1900-01-01T00:00:00.000Z")), b=T.date_or_null(F.lit("2026-09-10")), c=T.date_or_null(F.lit("2026-9-1")), d=T.minutes_or_null(F.lit("00:00:00")),
        e=T.minutes_or_null(F.lit("14:30:00")), f=T.blank_to_null(F.lit("  ")), g=T.date_or_null(F.lit(None).cast("string")), h=T.minutes_or_null(F.lit("7:61")),
    )
    assert tuple(r) == (None, dt.date(2026, 9, 10), None, None, 870, None, None, None)


def test_html_to_text():
    page = "<style>x{}</style><table><tr><td>a</td><td>b&nbsp;c</td></tr></table><p>one<br>two</p><!-- no --><script>z()</script>"
    assert T.plain_text(page) == "a b c\n\none\ntwo" and T.plain_text(None) == ""


def test_similarity_is_ordered_and_short_circuits():
    assert T.similarity("a" * 10, "a" * 100) == 0.1 and T.similarity("", "x") == 0 and T.similarity("same", "same") == 1
    assert T.spelling_only(["recieve"], ["receive"]) and not T.spelling_only(["monday"], ["friday"])


def test_redaction(spark):
    texts = ["mail a.b@c.org or token=abc123 at https://u:p@h/x", "Bearer abc.def and authorization=xyz, Authorization: Bearer q1", "  ", None, "y " * 400]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.redact(F.col("t")).alias("x")).collect()]
    assert got[:4] == ["mail [redacted-email] or [redacted] at https://[redacted]@h/x", "Bearer [redacted] and [redacted], Authorization: Bearer [redacted]", None, None] and len(got[4]) == 300


def test_folding_equals_the_decomposition(spark):
    import re
    import unicodedata

    texts = ["Éclair—Über ñandú (naïve)", "ǅ Ǆ ｆ", "a\u0301b", "Łódź straße", "日本 語", "", None, "snake_case 12"]
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", " ", "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower()).split())
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold(F.col("t")).alias("x")).collect()]
    assert [g for g, t in zip(got, texts, strict=True) if t != texts[1]] == [plain(t) for t in texts if t != texts[1]]


def found(spark, text, ref=dt.date(2026, 9, 1)):
    rows = spark.createDataFrame([(1, text)], "id int, t string")
    return [(r.event_date, r.start_min, r.end_min, r.session_index, r.session_count) for r in sessions.sessions(rows, "id", "t", F.lit(ref)).orderBy("session_index").collect()]


def test_session_lines(spark):
    assert found(spark, "Thursday, September 10 from 11:00-12:30\nMonday, September 21 from 2:30-4:00") == [(dt.date(2026, 9, 10), 660, 750, 1, 2), (dt.date(2026, 9, 21), 870, 960, 2, 2)]
    for no in ("Every Monday 9:00 - 10:00", None, "Friday, September 10 at 1-2 p.m.", "September 10. Doors open. 1-2 p.m.", "September 10 and 11/2 at 1-2 p.m.", "September 10, 1-2 p.m.\nSeptember 10, 4-5 p.m."):
        assert found(spark, no) == []  # recurring, empty, a weekday that contradicts the date, a sentence between, two dates, one day twice
    assert found(spark, "3-4 p.m. on 8/31") == [(dt.date(2026, 8, 31), 900, 960, 1, 1)] and found(spark, "3-4 p.m. on 8/30") == [(dt.date(2027, 8, 30), 900, 960, 1, 1)]


def test_repeating_schedules(spark):
    yes = ("Every Monday", "each\nweek", "every other week", "Mondays", "Mon - Thu", "monday through friday", "bi-weekly", "M/W/F", "m / w / f", "TTh", "an ongoing series", "Weekly")
    no = ("each Monday", "on Monday", "every one", "M/W", "ongoing", None, "", "5th week", "Monday, Friday")
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert {r.t for r in rows.filter(moments.recurs(F.col("t"))).collect()} == set(yes)


def test_readings_of_dates_and_times(spark):
    ref = F.lit(dt.date(2026, 9, 1))
    days = lambda t: [d.isoformat() for d in one(spark, x=F.transform(moments.dates(moments.read(moments.folded(F.lit(t))), ref), lambda d: d["day"])).x]
    assert days("Feb 29, 2028; Feb. 29, 2027, april 31 and 2/29/27") == ["2028-02-29"] and days("dismay 5, may 5") == ["2027-05-05"] and days("march 100, 110/14, 10/141, 1/2/123x") == ["2027-01-02"]
    spans = lambda t: [(r.start, r.end) for r in one(spark, x=moments.time_ranges(moments.read(moments.folded(F.lit(t))))).x]
    assert spans("9 to 10 a.m., 9:30 am - 1:15 p. m. and 2-4") == [(540, 600), (570, 795), (840, 960)] and spans("11:00 – 12:30; 11-1; 25:00-26:00; 5-4 p.m.") == [(660, 750), (660, 780)]
    assert spans("9:000-10") == [(0, 600)] and spans("") == []
    far = "words and " * 400
    assert moments and one(spark, x=moments.date_tokens(F.lit(f"{far} Monday, September 7 {far} 9/8/26 {far}"))).x == ["09-07", "2026-09-08"]
    assert one(spark, x=moments.first_time(F.lit(f"{far} at 6:30 pm"))).x == 1110


def test_named_days_labels_and_places(spark):
    days = lambda t: one(spark, x=moments.date_tokens(F.lit(t))).x
    assert days("Wed, Sept. 16, 2026; Sept 3rd, 1/2/27 and 10/31, not 13/40") == ["09-03", "10-31", "2026-09-16", "2027-01-02"]
    rows = spark.createDataFrame([(1, "Date: Sept 3\nWho: all\nmore\nLocation:\nRoom 5\n\nlast words")], "id int, t string")
    assert {(r.label, r.value) for r in sessions.labelled_fields(rows, "id", "t").collect()} == {("date", "Sept 3"), ("who", "all"), ("location", "Room 5")}
    r = one(spark, a=sessions.attendance(F.lit("on Zoom"), F.lit("Hall 1 (north)")), b=sessions.attendance(F.lit("on Zoom"), F.lit("virtual.")), c=sessions.attendance(F.lit("a talk"), F.lit(None).cast("string")))
    assert tuple(r.a) == ("hybrid", "Hall 1", "Zoom") and tuple(r.b) == ("virtual", None, "Zoom") and r.c.mode == "unknown"


def test_mentions_merge_and_keep_their_order(spark):
    rows = spark.createDataFrame([(1, "we use the Maple Hall Parking Garage, Lots A-1, B and C2 / D. Parking Lot O-1. a lot of people"), (2, "the Parking Garage"), (3, "a lot A of this"), (4, "Park in Lot 301 or Hall of the Arts Garage"), (5, None)], "id int, t string")
    got = {}
    for r in mentions.mentions(rows, "id", "t", {"lot o 1": "Lot O-1"}).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.matched_text, r.method, r.weak, r.lookup_keys[0]))
    assert got[1] == [("Maple Hall Parking Garage", "garage", False, "maple hall garage"), ("Lot A-1", "list", False, "lot a 1"), ("Lot B", "list", True, "lot b"), ("Lot C2", "list", False, "lot c 2"), ("Lot D", "list", True, "lot d"), ("Parking Lot O-1", "prefix", False, "lot o 1")]
    assert got[2] == [("the Parking Garage", "bare_garage", False, "parking garage")] and 3 not in got and 5 not in got
    assert [x[3] for x in got[4]] == ["lot 301", "hall of the arts garage"]
    r = one(spark, a=mentions.scannable(F.lit("Lot O-1")), b=mentions.scannable(F.lit("Lot A")), c=mentions.scannable(F.lit("Maple Garage")), d=mentions.scannable(F.lit("O-1")))
    assert tuple(r) == (True, False, True, False)


def test_points_of_concave_rings_lie_inside(spark):
    p = lambda lat, lon: F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    horseshoe = F.array(p(0, 0), p(0, 10), p(10, 10), p(10, 9), p(1, 9), p(1, 1), p(10, 1), p(10, 0))
    rows = spark.range(1).select(horseshoe.alias("ring"))
    r = geo.with_interior_point(rows, "ring", "i").select("ring", "i", geo.ring_centroid(F.col("ring")).alias("c")).first()
    ok = rows.select(geo.in_ring(F.col("ring"), F.lit(r.c.lat), F.lit(r.c.lon)).alias("c"), geo.in_ring(F.col("ring"), F.lit(r.i.lat), F.lit(r.i.lon)).alias("i")).first()
    assert not ok.c and ok.i
    r = one(spark, a=geo.usable_point(F.lit(39.0), F.lit(-75.0)), b=geo.usable_point(F.lit(float("nan")), F.lit(0.0)), c=geo.usable_point(F.lit(None).cast("double"), F.lit(0.0)))
    assert tuple(r) == (True, False, False)


def test_calendar_documents(spark):
    row = one(spark, x=calendar.document(F.lit("A, b; c\\d\ne" + "é" * 60), F.lit("2026-09-10").cast("date"), F.lit(600), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("t"), F.lit(7)), y=calendar.document(F.lit("t"), F.lit(None).cast("date"), F.lit(1), F.lit(2), F.lit(""), F.lit(""), F.lit(1)))
    lines = row.x.split("\r\n")
    assert all(len(x.encode()) <= 75 for x in lines) and row.y is None
    whole = row.x.replace("\r\n ", "")
    assert "SUMMARY:A\\, b\\; c\\\\d\\ne" + "é" * 60 in whole and "DTSTART:20260910T100000" in whole and "DTEND:20260910T110000" in whole and "LOCATION" not in whole


def test_geometry(spark):
    p = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    r = one(spark, c=geo.ring_centroid(F.array(p(0.0, 0.0), p(0.0, 2.0), p(2.0, 2.0), p(2.0, 0.0))), d=geo.compass(F.lit(39.7), F.lit(-75.1), F.lit(39.8), F.lit(-75.1)), q=geo.maps_query(F.lit(39.5), F.lit(-75.0)), t=geo.travel(F.lit(None).cast("double")), w=geo.travel(F.lit(600.0)))
    assert (r.c.lat, r.c.lon) == (1.0, 1.0) and r.d == "north" and r.q == "39.5,-75" and r.t.mode == "unresolved" and (r.w.mode, r.w.before) == ("walk", 15)


def test_titles_are_cleaned_until_nothing_more_goes(spark):
    want = {
        "EVENT: [FACULTY] REMINDER - Coffee  Hours (Focus on Research)": "Coffee Hours - Focus on Research", "Town Hall (Hybrid)": "Town Hall (Hybrid)", "Town Hall - Mon, Sept 10th, 2026": "Town Hall", "Hall (Hybrid) 9/10": "Hall (Hybrid",  # a date takes the brackets before it along
        "September 10": "September 10", "Open House 9/10/26 (10/4)": "Open House", "RIPPAC Fall Open House": "RIPPAC Fall Open House", "---": "---", "[A] [B] [C] [D] talk, ;": "talk",
        "Talk (see 10-12 below)": "Talk (see 10-12 below)", "event - x": "x", "Fest (a)": "Fest (a)", "  ": "other", None: "other",
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", calendar.clean_title(F.col("t"), F.lit(" other ")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == want
    deep = "[x] " * 40 + "end" + " (more words)" * 3
    assert spark.createDataFrame([(deep,)], "t string").select(calendar.clean_title(F.col("t"))).first()[0] == "end (more words) (more words) - more words"


def test_deep_links_are_encoded_and_short(spark):
    from urllib.parse import quote, urlencode

    bodies = ["", None, "short & sweet*~\x07 \r\nnext", "long text, " * 400, "é" * 900, "漢" * 199, "漢" * 900, "x" * 1500]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    link = calendar.deep_link("https://c.example/new", F.lit("A/B t\t"), F.lit("2026-09-10").cast("date"), F.lit(1410), F.lit(None).cast("int"), F.when(F.col("i") % 2 == 0, "Hall 1"), F.col("b"))
    for r in rows.select("i", link.alias("u")).collect():
        given = {"path": "/calendar/action/compose", "rru": "addevent", "startdt": "2026-09-10T23:30:00", "enddt": "2026-09-11T00:30:00", "subject": "A/B t"} | ({"location": "Hall 1"} if r.i % 2 == 0 else {})
        body = (bodies[r.i] or "").replace("\x07", "").replace(" \r\n", "\n").strip()
        whole = lambda b: "https://c.example/new?" + urlencode(given | ({"body": b} if b else {}), quote_via=quote)
        while len(whole(body)) > 1900 and len(body) > 200:
            body = body[: int(len(body) * 0.7)].rstrip() + "…"
        assert r.u == (whole(body) if len(whole(body)) <= 1900 else whole(""))
    assert spark.range(1).select(calendar.deep_link("b", F.lit("t"), F.lit(None).cast("date"), F.lit(1), F.lit(2), F.lit(""), F.lit(""))).first()[0] is None


def test_series_of_notices_and_why_some_are_held_back(spark):
    day = dt.date(2026, 9, 10)
    notices = {  # body: (title, is_event, date, start, end) and what comes out
        "two": ("Coffee hour", "Thursday, September 10 from 11:00-12:30\nMonday, September 21 from 2:30-4:00"), "dates": ("Fair", "September 10 and October 2, all day"), "none": ("Workshop", "Soon"), "untimed": ("Workshop", "On September 10"),
        "weekly": ("Meeting", "September 10. Every Monday 9:00-10:00"), "clash": ("Panel", "September 10\n9:00-11:00\n10:00-12:00"), "plain": ("Notice", "September 10, 9:00-10:00"), "due": ("Workshop", "Register by September 10, 9:00-10:00"),
        "label": ("Notice", "Date: Thursday, September 10\nTime: 9:00 - 10:00, 10:30 - 11:00\n\nClosing"), "single": ("Lecture", "September 10 at 6:30 pm"), "far": ("Workshop", "September 10, 9:00-10:00, 3:00-4:00"),
        "many": ("Tour", "\n".join(f"September {i} from 9:00-10:00" for i in range(10, 18))), "empty": (None, None),
    }
    rows = [(k, t, b, False, None, None, None) for k, (t, b) in notices.items()]
    rows += [("given", "Notice", "September 11, 13:00-15:00", True, day, 780, 840), ("back", "Notice", "", True, day, 780, 700), ("nulls", None, None, None, day, 600, None)]
    df = spark.createDataFrame(rows, "id string, title string, body_text string, is_event boolean, event_date date, event_start_min int, event_end_min int")
    got = {}
    for r in sessions.series(df, "id", F.lit("2026-09-01").cast("date")).collect():
        got.setdefault(r.id, []).append((r.event_date and (r.event_date.month, r.event_date.day), r.start_min, r.end_min, r.session_index, r.session_count, r.reason))
    held = lambda why: [(None, None, None, None, None, why)]
    once = lambda d, a, b: [((9, d), a, b, 1, 1, None)]
    assert {k: sorted(v) for k, v in got.items()} == {
        "two": [((9, 10), 660, 750, 1, 2, None), ((9, 21), 870, 960, 2, 2, None)], "dates": held("multiple_distinct_dates"), "none": held("no_event_date"), "untimed": held("no_event_time"), "weekly": held("recurring_schedule"),
        "clash": held("overlapping_time_blocks"), "plain": held("no_event_evidence"), "due": held("deadline_not_event"), "label": once(10, 540, 660), "single": once(10, 1110, None), "far": once(10, 540, 600), "many": held("too_many_sessions"),
        "empty": held("no_event_date"), "given": once(10, 780, 900), "back": held("end_before_start"), "nulls": once(10, 600, None),
    }
    assert sessions.series(df.limit(0), "id", F.lit("2026-09-01").cast("date")).count() == 0


def test_headings_that_repeat_the_title_go(spark):
    from noticeflow.functions import headings

    pages = {
        "<h2>Fall&nbsp;&ldquo;Fair&rdquo;!</h2><p>Body</p>": "<p>Body</p>", "\n <div><div><b>FALL</b> “fair”<br></div></div>Body <p>x</p>": "\n Body <p>x</p>", '<p>Fall "Fair" <a href="x">x</a></p>Body': None,
        '<p><a href="x">Fall "Fair"</a></p>': None, '<p><img src="x">Fall "Fair"</p>': None, 'Text <h1>Fall "Fair"</h1>': None, '<h1>Fall "Fair" again</h1>': None, '<h1>Fall "Fair"': None, "<br><h1>Fall “Fair”</h1>": None,
        '<p>Fall "Fair"</p>': "", "": None, '<address>Fall "Fair"</address>': None, '<p>Fall<br/>"Fair"<wbr></p>tail <b>': "tail <b>",
    }
    rows = spark.createDataFrame([(p,) for p in pages], "p string").select("p", headings.without_heading(F.col("p"), F.lit(" Fall  ‘ ").substr(1, 7)).alias("other"), headings.without_heading(F.col("p"), F.lit(' Fall "Fair". ')).alias("x"), headings.without_heading(F.col("p"), F.lit("!")).alias("y")).collect()
    assert {r.p: r.x for r in rows} == {p: p if x is None else x for p, x in pages.items()}
    assert all(r.y == r.p and r.other == r.p for r in rows)
    texts = {"Fall “Fair”!\n\n  \nBody\n\nmore": "Body\n\nmore", "\n \nFALL \"fair\"": "", "Other\nFall \"Fair\"": None, "": None, "Fall \"Fair\"\n  Body": "  Body"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", headings.without_first_line(F.col("t"), F.lit('Fall "Fair"')).alias("x")).collect()
    assert {r.t: r.x for r in got} == {t: t if x is None else x for t, x in texts.items()}
    assert one(spark, a=headings.without_heading(F.lit(None).cast("string"), F.lit("x")), b=headings.without_first_line(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ("", "")


def test_spellings_of_places(spark):
    names = ["Lot Q-1", "Parking Lot 301", "V7 Lot", "Tower Parking Garage", "Field House", "Lot", "", None, "Lot Old Mill"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k int, n string")
    got = {r.k: [x.alias for x in r.s] for r in rows.select("k", mentions.spellings(F.col("n")).alias("s")).collect()}
    assert got == {
        0: ["Lot Q-1", "Parking Lot Q-1", "Q-1 Lot", "Q-1"], 1: ["Parking Lot 301", "Lot 301", "301 Lot", "301"], 2: ["V7 Lot", "V7 Lot Lot", "Parking V7 Lot", "V7 Lot Parking"],
        3: ["Tower Parking Garage", "Tower Parking Garage Lot", "Parking Tower Parking Garage", "Tower Parking Garage Parking", "Tower Garage"], 4: ["Field House", "Field House Lot", "Parking Field House", "Field House Parking"],
        5: ["Lot", "Lot Lot", "Parking Lot", "Lot Parking"], 6: [], 7: [],
        8: ["Lot Old Mill", "Parking Lot OLD-MILL", "OLD-MILL Lot", "OLD-MILL"],
    }


def test_sessions_with_travel(spark):
    day = dt.date(2026, 9, 10)
    cols = "notice string, content_hash string, title string, event_date date, start_min int, end_min int, session_count int, location string, description string, address string, minutes_before int, minutes_after int, mode string"
    rows = [
        ("a", "h", "Talk, one", day, 10, 60, 1, "Hall 1", "d", "https://x.example", 15, 20, "drive"), ("b", None, None, day, 1430, None, 3, None, None, None, None, 0, None), ("c", "h", "t", None, 10, 20, 1, "", "", "", 5, 5, "walk"),
        ("d", "h", "long " * 100, day, 600, 500, 1, None, "é" * 100, None, -5, 5, "walk"), ("e", "h", "t", day, None, 20, 1, "", "", "", 5, 5, "walk"), ("a", "h", "Talk, one", day, 10, 60, 1, "Hall 1", "d", "https://x.example", 15, 20, "drive"),
    ]
    got = {r.notice: r for r in calendar.with_travel(spark.createDataFrame(rows, cols)).collect()}
    assert [tuple(b)[:5] for b in got["a"].blocks] == [("travel_outbound", "travel-out", -5, 10, "Drive to Hall 1"), ("event", "event", 10, 60, "Talk, one"), ("travel_return", "travel-back", 60, 80, "Drive from Hall 1")]
    assert "DTSTART;TZID=America/New_York:20260909T235500\r\n" in got["a"].document and got["a"].document.count("BEGIN:VEVENT") == 3 and "SUMMARY:Talk\\, one" in got["a"].document
    assert [tuple(b)[:5] for b in got["b"].blocks] == [("event", "event-2026-09-10", 1430, 1490, "")] and "DTEND;TZID=America/New_York:20260911T005000" in got["b"].document
    assert got["c"].document is None and got["c"].blocks is None and got["e"].document is None
    assert [b.kind for b in got["d"].blocks] == ["event", "travel_return"] and len(got["d"].blocks[1].summary) <= 121 and all(len(line.encode()) <= 75 for line in got["d"].document.split("\r\n"))
    assert got["a"].blocks[0].description == "Travel time reserved before Talk, one.\nThe event itself starts at 12:10 AM." and calendar.zone_lines().count("END:DAYLIGHT") == 1
    assert calendar.with_travel(spark.createDataFrame([], cols)).count() == 0
