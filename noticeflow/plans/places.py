"""Places on inline rows and on names of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as T
from ..operators import places
from .registry import query, table

#: Points in clusters of fifty, each half a kilometre wide.
_LANDMARKS = """SELECT CAST(s_suppkey % 3 AS {text}) AS campus, s_name AS name, 30e0 + floor(s_suppkey / 50) % 2000 * 0.02e0 + s_suppkey * 37 % 50 / 10000e0 AS lat, -75e0 + s_suppkey * 91 % 47 / 10000e0 AS lon FROM supplier"""


@query("""
SELECT p_name || ' ' || p_size AS name, min(p_brand) AS p_brand FROM part WHERE length(p_name || ' ' || p_size) >= 6 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1
""")
def unique_name_index(spark, d):
    return places.unique_names(table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("name"), "p_brand"), "name", "p_brand", 6)


@query("""
WITH m AS (SELECT c_custkey AS mention_id, c_mktsegment AS alias, c_nationkey AS hint FROM customer),
a AS (SELECT DISTINCT c_mktsegment AS alias, c_nationkey AS campus, (c_nationkey % 7) AS place_id FROM customer WHERE c_acctbal > 5000),
h AS (SELECT mention_id, campus, place_id, hint, max((campus = hint)::INT) OVER (PARTITION BY mention_id) AS same FROM m JOIN a USING (alias)),
o AS (SELECT mention_id, count(DISTINCT place_id) AS n, min(place_id) AS place_id FROM h WHERE same = 0 OR campus = hint GROUP BY 1)
SELECT m.mention_id, CASE WHEN n = 1 THEN o.place_id END AS place_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS reason FROM m LEFT JOIN o USING (mention_id)
""")
def alias_ambiguity(spark, d):
    c = table(spark, d, "customer")
    mentions = c.select(F.col("c_custkey").alias("mention_id"), F.array("c_mktsegment").alias("lookup_keys"), F.col("c_nationkey").alias("campus_hint"))
    aliases = c.filter("c_acctbal > 5000").select(F.col("c_mktsegment").alias("alias"), F.col("c_nationkey").alias("campus"), (F.col("c_nationkey") % 7).alias("place_id")).distinct()
    return places.resolve(mentions, aliases)


@query(f"""
WITH marks AS ({_LANDMARKS.format(text="VARCHAR")}), x AS (SELECT a.campus, a.name AS place, b.name AS landmark, a.lat, a.lon, sqrt(pow((b.lon - a.lon) * 111320.0 * cos(radians(a.lat)), 2) + pow((b.lat - a.lat) * 111320.0, 2)) AS m,
  (degrees(atan2((b.lon - a.lon) * cos(radians(a.lat)), b.lat - a.lat)) + 360) % 360 AS angle
  FROM marks a JOIN marks b ON a.campus = b.campus AND a.name <> b.name)
SELECT campus, place, landmark, row_number() OVER (PARTITION BY campus, place ORDER BY m, landmark)::INT AS rank, round(m, 6) AS metres,
  (['north', 'north-northeast', 'northeast', 'east-northeast', 'east', 'east-southeast', 'southeast', 'south-southeast', 'south', 'south-southwest', 'southwest', 'west-southwest', 'west', 'west-northwest', 'northwest', 'north-northwest'])[(floor((angle + 11.25) / 22.5)::INT % 16) + 1] AS direction
FROM x WHERE m <= 400 QUALIFY rank <= 8
""")
def geo_nearest(spark, d):
    """Each supplier's nearest ones of its campus, with the direction."""
    k = F.col("s_suppkey")
    lat, lon = F.lit(30.0) + F.floor(k / 50) % 2000 * F.lit(0.02) + k * 37 % 50 / F.lit(10000.0), F.lit(-75.0) + k * 91 % 47 / F.lit(10000.0)
    marks = table(spark, d, "supplier").select((k % 3).cast("string").alias("campus"), F.col("s_name").alias("name"), lat.alias("lat"), lon.alias("lon"))
    return places.nearest(marks, marks)


@query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE abs(s_acctbal) * 0.9 END AS m FROM supplier),
b AS (SELECT s_suppkey, m, least(90, greatest(10, ceil((m * 1.25 / 1.3 / 60 + 3) / 5) * 5)) AS walk, m * 1.35 / (40000 / 3600.0) / 60 AS drive FROM s)
SELECT s_suppkey, CASE WHEN m IS NULL THEN 'unresolved' WHEN m < 60 THEN 'at_base' WHEN m <= 1200 THEN 'walk' ELSE 'drive' END AS mode,
  (CASE WHEN m IS NULL OR m < 60 THEN 0 WHEN m <= 1200 THEN walk ELSE least(90, greatest(10, ceil((drive + 10) / 5) * 5)) END)::INT AS before,
  (CASE WHEN m IS NULL OR m < 60 THEN 0 WHEN m <= 1200 THEN walk ELSE least(90, greatest(10, ceil((drive + 5) / 5) * 5)) END)::INT AS after FROM b
""")
def travel_plan(spark, d):
    metres = F.when(F.col("s_suppkey") % 11 != 0, F.abs("s_acctbal") * 0.9)
    return table(spark, d, "supplier").select("s_suppkey", geo.travel(metres).alias("t")).select("s_suppkey", "t.*")


@query("""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')) AS name_key FROM part
""".replace("\\\\", "\\"))
def facility_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.facility_name(F.col("p_name")).alias("name_key"))
