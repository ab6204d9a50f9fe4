"""Activity sessions, mentions, venues and calendar entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import calendar
from ..operators import places, quality
from ..streaming import feeds
from .registry import query, table


@query("""
WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*)::BIGINT AS n FROM g GROUP BY user_id, s
""")
def session_windows(spark, d):
    return feeds.activity(table(spark, d, "events"), "user_id", "ts")


@query("SELECT ts::DATE AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def day_windows(spark, d):
    return feeds.day_windows(table(spark, d, "events"), "ts", "event_type")


@query("""
WITH v AS (SELECT c_custkey AS id, lower(c_mktsegment) AS venue FROM customer),
c AS (SELECT lower(c_mktsegment) AS venue, min(c_custkey) AS place FROM customer WHERE c_nationkey = 1 AND c_mktsegment < 'C' GROUP BY 1), l AS (SELECT lower(c_mktsegment) AS venue, min(c_custkey) AS place FROM customer WHERE c_nationkey = 2 AND c_mktsegment < 'H' GROUP BY 1)
SELECT id, coalesce(c.place, l.place) AS place, CASE WHEN c.place IS NOT NULL THEN 'cache' WHEN l.place IS NOT NULL THEN 'landmark' ELSE 'unresolved' END AS via FROM v LEFT JOIN c USING (venue) LEFT JOIN l USING (venue)
""")
def venue_resolution(spark, d):
    """A venue from the first source that knows it."""
    c = table(spark, d, "customer").withColumn("venue", F.lower("c_mktsegment"))
    known = lambda n, under: c.filter((F.col("c_nationkey") == n) & (F.col("c_mktsegment") < under)).groupBy("venue").agg(F.min("c_custkey").alias("place"))
    return places.first_known(c.select(F.col("c_custkey").alias("id"), "venue"), "venue", {"cache": known(1, "C"), "landmark": known(2, "H")}).select("id", "place", "via")


@query(r"""
WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderdate::DATE AS day, (o_orderkey % 1440)::INT AS m FROM orders), t AS (SELECT *, strftime(day, '%Y%m%d') AS d, day + INTERVAL 1 MINUTE * m AS s FROM o)
SELECT o_orderkey, array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//noticeflow//EN', 'BEGIN:VEVENT', 'UID:' || substr(sha256(o_orderkey || '|' || day || '|' || m), 1, 32) || '@noticeflow', 'DTSTAMP:' || d || 'T000000Z', 'DTSTART:' || strftime(s, '%Y%m%dT%H%M00'),
  'DTEND:' || strftime(s + INTERVAL 1 HOUR, '%Y%m%dT%H%M00'), 'SUMMARY:Order\, of\; ' || o_orderpriority, 'LOCATION:Hall\\1', 'DESCRIPTION:x', 'END:VEVENT', 'END:VCALENDAR', ''], chr(13) || chr(10)) AS entry FROM t
""")
def calendar_documents(spark, d):
    """Orders as events: a calendar document for each."""
    o = table(spark, d, "orders")
    title = F.concat(F.lit("Order, of; "), F.col("o_orderpriority"))
    entry = calendar.document(title, F.to_date("o_orderdate"), (F.col("o_orderkey") % 1440).cast("int"), F.lit(None).cast("int"), F.lit("Hall\\1"), F.lit("x") , F.col("o_orderkey"))
    return o.select("o_orderkey", entry.alias("entry"))


_ZONE_LINES = ", ".join(f"'{x}'" for x in calendar.zone_lines())


@query(rf"""
WITH o AS (SELECT o_orderkey AS notice, o_orderdate::DATE AS day, (o_orderkey % 1440)::INT AS s, CASE WHEN o_custkey % 5 = 0 THEN (o_orderkey % 1440 + 90)::INT ELSE (o_orderkey % 1440 + 60)::INT END AS e, o_custkey % 3 * 30 AS b, o_custkey % 2 * 45 AS a,
  o_orderkey % 4 = 0 AS several, CASE WHEN o_custkey % 7 > 0 THEN 'Hall, 1' END AS place, CASE WHEN o_custkey % 4 = 1 THEN 'Drive' ELSE 'Travel' END AS verb, o_orderpriority AS title, o_orderstatus AS hash FROM orders),
k AS (SELECT * FROM (SELECT *, 0 AS i, 'travel_outbound' AS kind, 'travel-out' AS suffix, s - b AS f, s AS t FROM o WHERE b > 0 UNION ALL SELECT *, 1, 'event', 'event', s, e FROM o UNION ALL SELECT *, 2, 'travel_return', 'travel-back', e, e + a FROM o WHERE a > 0)),
n AS (SELECT *, suffix || CASE WHEN several THEN '-' || day ELSE '' END AS own FROM k),
v AS (SELECT notice, i, kind, concat_ws(chr(10), 'BEGIN:VEVENT', 'UID:' || substr(sha256(notice || ':' || hash || ':' || own), 1, 32) || '-' || own || '@noticeflow', 'DTSTAMP:' || strftime(day, '%Y%m%d') || 'T000000Z',
  'DTSTART;TZID=America/New_York:' || strftime(day + INTERVAL 1 MINUTE * f, '%Y%m%dT%H%M00'), 'DTEND;TZID=America/New_York:' || strftime(day + INTERVAL 1 MINUTE * t, '%Y%m%dT%H%M00'),
  'SUMMARY:' || CASE i WHEN 0 THEN verb || ' to ' || replace(coalesce(place, title), ',', '\,') WHEN 1 THEN title ELSE verb || ' from ' || replace(coalesce(place, title), ',', '\,') END,
  CASE i WHEN 1 THEN 'DESCRIPTION:x\; y' END, CASE WHEN place IS NOT NULL THEN 'LOCATION:Hall\, 1' END, CASE i WHEN 1 THEN 'URL:https://notices.example/' || notice END, 'TRANSP:OPAQUE', 'X-NOTICEFLOW-BLOCK:' || kind, 'END:VEVENT') AS event,
  CASE i WHEN 0 THEN 'Travel time reserved before ' || title || '.' || chr(10) || 'The event itself starts at ' || strftime(day + INTERVAL 1 MINUTE * s, '%-I:%M %p') || '.' WHEN 1 THEN 'x; y' ELSE 'Return travel reserved after ' || title || '.' || chr(10) || 'The event itself ends at ' || strftime(day + INTERVAL 1 MINUTE * e, '%-I:%M %p') || '.' END AS said FROM n)
SELECT notice, string_agg(kind, ',' ORDER BY i) AS kinds, string_agg(said, '|' ORDER BY i) AS said, array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//noticeflow//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', {_ZONE_LINES}, string_agg(event, chr(10) ORDER BY i), 'END:VCALENDAR', ''], chr(10)) AS entry FROM v GROUP BY notice
""")
def travel_entries(spark, d):
    """Orders as sessions with the way there and back; ``entry`` is the unfolded document without the holds' descriptions, which ``said`` has."""
    o, at = table(spark, d, "orders"), (F.col("o_orderkey") % 1440).cast("int")
    rows = o.select(
        F.col("o_orderkey").alias("notice"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").alias("event_date"), at.alias("start_min"), F.when(F.col("o_custkey") % 5 == 0, at + 90).alias("end_min"),
        F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1).alias("session_count"), F.when(F.col("o_custkey") % 7 > 0, "Hall, 1").alias("location"), F.lit("x; y").alias("description"), F.concat(F.lit("https://notices.example/"), "o_orderkey").alias("address"),
        (F.col("o_custkey") % 3 * 30).cast("int").alias("minutes_before"), (F.col("o_custkey") % 2 * 45).cast("int").alias("minutes_after"), F.when(F.col("o_custkey") % 4 == 1, "drive").otherwise("walk").alias("mode"),
    )
    unfolded = F.replace(F.replace(F.col("document"), F.lit("\r\n "), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    entry = F.regexp_replace(unfolded, "DESCRIPTION:(?:Travel time|Return travel) [^\n]*\n", "")
    joined = lambda name, by: F.array_join(F.transform("blocks", lambda b: b[name]), by)
    return calendar.with_travel(rows).select("notice", joined("kind", ",").alias("kinds"), joined("description", "|").alias("said"), entry.alias("entry"))


_SUBJECT = """CASE c_custkey % 7 WHEN 0 THEN concat('EVENT: [FACULTY]  Coffee Hours no ', c_custkey, ' (Focus on Research)') WHEN 1 THEN concat('Town Hall ', c_custkey, ' (Hybrid)')
  WHEN 2 THEN concat(c_mktsegment, ' - Talk on tour ', c_custkey, ' - Thursday, September 10th, 2026') WHEN 3 THEN 'September 10' WHEN 4 THEN concat('[EVENT] tour ', c_custkey, ' 9/10/26 (10/4)') WHEN 5 THEN '   ' END"""


@query("""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Coffee Hours no ' || c_custkey || ' - Focus on Research' WHEN 1 THEN 'Town Hall ' || c_custkey || ' (Hybrid)' WHEN 2 THEN 'Talk on tour ' || c_custkey WHEN 3 THEN 'September 10'
  WHEN 4 THEN 'tour ' || c_custkey ELSE c_name END AS title FROM customer
""")
def calendar_titles(spark, d):
    """Titles of notices made of each customer, cleaned for a calendar."""
    return table(spark, d, "customer").select("c_custkey", calendar.clean_title(F.expr(_SUBJECT), F.col("c_name")).alias("title"))


@query(rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents),
f AS (SELECT doc_id, body, 'https://calendar.example/new?path=%2Fcalendar%2Faction%2Fcompose&rru=addevent&startdt=2026-09-10T' || lpad((doc_id % 24)::VARCHAR, 2, '0') || '%3A05%3A00&enddt=2026-09-' || CASE WHEN doc_id % 24 = 23 THEN '11T00' ELSE '10T' || lpad((doc_id % 24 + 1)::VARCHAR, 2, '0') END
  || '%3A05%3A00&subject=Notice%20' || doc_id || '%3A%20a%2Fb' AS fixed FROM t),
b AS (SELECT doc_id, fixed, body, 0 AS i FROM f UNION ALL
  SELECT doc_id, fixed, regexp_replace(substr(body, 1, floor(length(body) * {S.LINK_SHRINK}::DOUBLE)::INT), '\s+$', '') || '…', i + 1 FROM b WHERE length(body) > {S.LINK_BODY_CHARS} AND length(fixed) + 6 + length(url_encode(body)) > {S.LINK_CHARS})
SELECT doc_id, CASE WHEN body = '' OR length(fixed) + 6 + length(url_encode(body)) > {S.LINK_CHARS} THEN fixed ELSE fixed || '&body=' || url_encode(body) END AS link FROM (SELECT doc_id, fixed, max_by(body, i) AS body FROM b GROUP BY ALL)
""")
def calendar_links(spark, d):
    """Documents as descriptions of sessions: the address of a calendar's form."""
    link = calendar.deep_link(
        "https://calendar.example/new", F.concat(F.lit("Notice "), "doc_id", F.lit(": a/b")), F.lit("2026-09-10").cast("date"), (F.col("doc_id") % 24 * 60 + 5).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.col("text"),
    )
    return table(spark, d, "documents").select("doc_id", link.alias("link"))


_ADDRESS = "CASE l_linenumber % 4 WHEN 0 THEN 'http://other.example' WHEN 1 THEN 'https://calendar.example/new?subject=a b' ELSE 'https://calendar.example/new?subject=a' END"
_ENTRY = "CASE l_orderkey % 3 WHEN 0 THEN concat('BEGIN:VCALENDAR', chr(13), chr(10), 'END:VCALENDAR', chr(13), chr(10)) WHEN 1 THEN concat('BEGIN:VCALENDAR', chr(13), chr(10), 'END') END"


@query("""
WITH r AS (SELECT l_orderkey AS notice, l_linenumber AS session, (l_suppkey % 4) * 60 AS start_min, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 300 END AS end_min, l_linenumber % 4 AS k, CASE WHEN l_orderkey % 11 = 0 THEN 'a/b.ics' WHEN l_orderkey % 13 = 0 THEN 'a.ics' ELSE 's' || l_linenumber || '.ics' END AS file FROM lineitem), t AS (SELECT *, count(*) OVER (PARTITION BY notice, start_min) AS n FROM r)
SELECT notice, session, CASE WHEN notice % 7 = 0 THEN 'title' WHEN end_min <= start_min THEN 'end' WHEN k = 0 THEN 'address' WHEN k = 1 THEN 'character' WHEN notice % 3 = 1 THEN 'document' WHEN notice % 3 = 0 AND notice % 11 = 0 THEN 'file' WHEN n > 1 THEN 'start' WHEN c > 1 THEN 'name' END AS fault
FROM (SELECT *, count(*) OVER (PARTITION BY notice, file) AS c FROM t)
""")
def session_faults(spark, d):
    """Sessions made of line items, and what keeps them from a digest."""
    i, key = table(spark, d, "lineitem"), F.col("l_orderkey")
    start = ((F.col("l_suppkey") % 4) * 60).cast("int")
    name = F.when(key % 11 == 0, "a/b.ics").when(key % 13 == 0, "a.ics").otherwise(F.concat(F.lit("s"), "l_linenumber", F.lit(".ics")))
    rows = i.select(
        key.alias("notice"), F.col("l_linenumber").alias("session"), F.when(key % 7 == 0, " ").otherwise("Talk").alias("title"), F.lit("2026-09-10").cast("date").alias("event_date"), start.alias("start_min"),
        F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(300).alias("end_min"), F.expr(_ADDRESS).alias("link"), F.expr(_ENTRY).alias("document"), name.alias("file_name"),
    )
    return quality.session_faults(rows, "notice", "https://calendar.example/new").select("notice", "session", "fault")
