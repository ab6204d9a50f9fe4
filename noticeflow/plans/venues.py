"""Venues of notices, looked up in a cache and by their names' fragments, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import venues
from .registry import query, table

_KEY = "trim(regexp_replace(replace(lower({}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_ROWS = """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 5 != 0 THEN CAST(o_custkey % 4 AS {text}) END AS hint,
  CASE o_orderkey % 9 WHEN 0 THEN concat(n_name, ' Hall ', CAST(o_custkey % 40 AS {text}), ', Great Ballroom') WHEN 1 THEN concat('Room 12 - ', n_name, ' Hall ', CAST(o_custkey % 40 AS {text}))
    WHEN 2 THEN concat(n_name, '  Hall ', CAST(o_custkey % 40 AS {text}), ' 2nd Floor Lounge') WHEN 3 THEN concat('Lot ', CAST(o_custkey % 60 AS {text}), '; Deck') WHEN 4 THEN concat('The Hall ', CAST(o_custkey % 40 AS {text}))
    WHEN 5 THEN '' WHEN 6 THEN concat('Hall ', CAST(o_custkey % 40 AS {text}), ' & Annex | ', 'Suite B-4') WHEN 7 THEN concat(n_name, ' Hall') ELSE concat('Nowhere ', CAST(o_custkey AS {text})) END AS venue
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""
_LANDMARKS = "SELECT concat('The ', n_name, ' Hall ', CAST(s_suppkey % 40 AS {text})) AS name, CAST(s_suppkey % 4 AS {text}) AS campus, CAST(s_suppkey AS DOUBLE) AS latitude, CAST(-s_suppkey AS DOUBLE) AS longitude FROM supplier JOIN nation ON n_nationkey = s_nationkey"
_FACILITIES = "SELECT concat('Lot ', CAST(p_partkey % 60 AS {text})) AS name, CAST(p_partkey % 2 AS {text}) AS campus, CAST(p_partkey AS DOUBLE) AS latitude, CAST(p_partkey AS DOUBLE) AS longitude FROM part WHERE p_partkey <= 80"
_CACHE = """SELECT {key} AS key, venue AS name, 'c' AS campus, CASE WHEN id % 7 != 0 THEN CAST(id AS DOUBLE) END AS latitude, 0e0 AS longitude, CASE WHEN id % 5 != 0 THEN CAST(id % 60 AS INT) END AS minutes,
  CAST(id % 3 = 0 AS {text}) AS fingerprint, {later} AS verified FROM rows WHERE id % 11 = 0"""

_OWN = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'))"


@query(f"""
WITH rows AS ({_ROWS.format(text="VARCHAR")}), landmarks AS ({_LANDMARKS.format(text="VARCHAR")}), facilities AS ({_FACILITIES.format(text="VARCHAR")}),
cache AS ({_CACHE.format(key=_KEY.format("venue"), text="VARCHAR", later="day + CAST(id % 50 AS INT)")}),
keyed AS (SELECT *, {_KEY.format("venue")} AS key FROM rows),
known AS (
  SELECT k.id, k.day, k.hint, k.venue, k.key, arg_max(c, (c.verified, c.name, c.latitude, c.minutes)) FILTER (WHERE c.key IS NOT NULL) AS c
  FROM keyed k LEFT JOIN cache c ON c.key = k.key AND c.key != '' AND c.verified <= k.day GROUP BY ALL
),
states AS (
  SELECT *, CASE WHEN key = '' THEN 'none' WHEN c.latitude IS NOT NULL AND c.minutes IS NOT NULL AND c.fingerprint = 'true' AND c.verified >= day - 30 THEN 'hit' WHEN c.latitude IS NOT NULL THEN 'stale' ELSE 'miss' END AS state FROM known
),
parts AS (SELECT DISTINCT key, hint, min(venue) OVER (PARTITION BY key, hint) AS venue FROM states WHERE state = 'miss'),
split AS (SELECT key, hint, trim(regexp_replace(venue, '\\s+', ' ', 'g')) AS whole FROM parts),
pieces AS (SELECT key, hint, list_distinct_in_order AS ps FROM (
  SELECT key, hint, list_filter(list_prepend(whole, list_transform(string_split_regex(whole, '[,;|]|\\s-|-\\s'), lambda p: trim(p, ' .,;:-'))), lambda p: p != '') AS list_distinct_in_order FROM split)),
steps AS (
  SELECT key, hint, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n FROM pieces
),
bare AS (
  SELECT *, trim(regexp_replace(regexp_replace(piece, '(?i)\\b(room|rm|suite|ste)\\.?\\s*[a-z]?-?[0-9]+[a-z]?\\b|\\b[0-9]+(st|nd|rd|th) floor\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM steps
),
short AS (SELECT *, trim(regexp_replace(b, '(?i)((^|\\s+)(ballroom|lounge|room|suite|floor|deck))+$', ''), ' .,;:-') AS s FROM bare),
ladder AS (SELECT key, hint, 2 * n AS step, piece AS fragment FROM short UNION ALL SELECT key, hint, 2 * n + 1, s FROM short WHERE s LIKE '% %'),
asked AS (SELECT key, hint, min(step) AS step, fragment, {_OWN.format("fragment")} AS name_key FROM ladder GROUP BY key, hint, fragment),
marks AS (SELECT *, {_OWN.format("name")} AS own FROM landmarks),
names AS (
  SELECT a.key, a.hint, a.step, a.fragment, 0 AS rung, m.name, m.campus, m.latitude, m.longitude FROM asked a JOIN marks m ON m.own = a.name_key
  UNION ALL SELECT a.key, a.hint, a.step, a.fragment, 1, m.name, m.campus, m.latitude, m.longitude FROM asked a JOIN marks m ON m.own != a.name_key AND length(a.name_key) >= 6 AND contains(' ' || m.own || ' ', ' ' || a.name_key || ' ')
  UNION ALL SELECT a.key, a.hint, a.step, a.fragment, 2, f.name, f.campus, f.latitude, f.longitude FROM asked a JOIN (SELECT *, {_OWN.format("name")} AS own FROM facilities) f ON f.own = a.name_key
),
told AS (
  SELECT key, hint, step, fragment, rung, CASE WHEN count(*) = 1 THEN min((name, campus, latitude, longitude)) WHEN count(*) FILTER (WHERE campus = hint) = 1 THEN min((name, campus, latitude, longitude)) FILTER (WHERE campus = hint)
    WHEN count(DISTINCT campus) = 1 THEN min((name, campus, latitude, longitude)) END AS place FROM names GROUP BY ALL
),
tried AS (SELECT * FROM told t WHERE NOT (rung = 1 AND EXISTS (SELECT 1 FROM told u WHERE u.rung = 0 AND u.key = t.key AND u.hint IS NOT DISTINCT FROM t.hint AND u.step = t.step))),
best AS (SELECT * FROM tried WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, hint ORDER BY rung = 2, step) = 1)
SELECT id, s.key, state, CASE WHEN state IN ('hit', 'stale') THEN 'cache' WHEN b.rung = 2 THEN 'facility' WHEN b.rung IS NOT NULL THEN 'landmark' END AS source, b.fragment,
  CASE WHEN state = 'miss' THEN b.place[2] WHEN state != 'none' THEN c.campus END AS campus, CASE WHEN state = 'miss' THEN b.place[3] WHEN state != 'none' THEN c.latitude END AS latitude, CASE WHEN state = 'hit' THEN c.minutes END AS minutes
FROM states s LEFT JOIN best b ON state = 'miss' AND b.key = s.key AND b.hint IS NOT DISTINCT FROM s.hint
""")
def venue_lookups(spark, d):
    """Each notice's venue: from the cache as it was on its day, or by the ladder of its name's fragments."""
    for t in ("orders", "customer", "nation", "supplier", "part"):
        table(spark, d, t).createOrReplaceTempView(f"venue_{t}")

    def ask(sql):
        sql = sql.format(text="STRING", key="", later="")
        for t in ("orders", "customer", "nation", "supplier", "part"):
            sql = sql.replace(f"FROM {t}", f"FROM venue_{t}").replace(f"JOIN {t}", f"JOIN venue_{t}")
        return spark.sql(sql)

    rows = ask(_ROWS)
    cache = rows.filter("id % 11 = 0").selectExpr(
        "venue", "venue AS name", "'c' AS campus", "CASE WHEN id % 7 != 0 THEN CAST(id AS DOUBLE) END AS latitude", "0e0 AS longitude", "CASE WHEN id % 5 != 0 THEN CAST(id % 60 AS INT) END AS minutes",
        "CAST(id % 3 = 0 AS STRING) AS fingerprint", "date_add(day, CAST(id % 50 AS INT)) AS verified",
    ).withColumn("key", venues.venue_key(F.col("venue")))
    found = venues.looked_up(rows, cache, ask(_LANDMARKS), ask(_FACILITIES), F.lit("true"), days=30)
    return found.select("id", "key", "state", "source", "fragment", "campus", "latitude", "minutes")
