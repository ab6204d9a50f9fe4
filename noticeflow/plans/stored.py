"""Upserts with column rules and checks of stored days on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import mentions
from ..operators import digest, upserts
from ..sources import artifacts
from .registry import query, table

_OLD_VENUES = """SELECT c_name AS normalized_venue, c_name AS display_name, CASE WHEN c_custkey % 3 != 0 THEN c_mktsegment END AS campus, CAST(c_acctbal AS DOUBLE) AS latitude, CAST(c_custkey AS INT) AS outbound_minutes,
  CASE WHEN c_custkey % 4 != 0 THEN 'walk' END AS travel_mode, c_custkey % 2 = 0 AS routing_estimated, 'old' AS first_seen_at, 'old' AS last_verified_at FROM customer WHERE c_custkey % 5 != 0"""
_NEW_VENUES = """SELECT c_name AS normalized_venue, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, '!') END AS display_name, CASE WHEN c_custkey % 7 != 0 THEN 'new' END AS campus, CASE WHEN c_custkey % 6 != 0 THEN 1e0 END AS latitude,
  CASE WHEN c_custkey % 8 < 4 THEN 99 END AS outbound_minutes, 'drive' AS travel_mode, CASE WHEN c_custkey % 9 != 0 THEN false END AS routing_estimated, 'new' AS first_seen_at, 'new' AS last_verified_at FROM customer WHERE c_custkey % 4 != 1"""


def _ask(spark, d, sql, *names):
    for t in names:
        table(spark, d, t).createOrReplaceTempView(f"stored_{t}")
        sql = sql.replace(f"FROM {t}", f"FROM stored_{t}")
    return spark.sql(sql)


@query(f"""
WITH e AS ({_OLD_VENUES}), n AS ({_NEW_VENUES}) SELECT normalized_venue, coalesce(n.display_name, e.display_name) AS display_name, coalesce(n.campus, e.campus) AS campus, coalesce(n.latitude, e.latitude) AS latitude,
  coalesce(n.outbound_minutes, e.outbound_minutes) AS outbound_minutes, CASE WHEN e.first_seen_at IS NULL OR n.outbound_minutes IS NOT NULL THEN n.travel_mode ELSE e.travel_mode END AS travel_mode,
  CASE WHEN e.first_seen_at IS NULL OR n.outbound_minutes IS NOT NULL THEN n.routing_estimated ELSE e.routing_estimated END AS routing_estimated, coalesce(e.first_seen_at, n.first_seen_at) AS first_seen_at, coalesce(n.last_verified_at, e.last_verified_at) AS last_verified_at
FROM e FULL JOIN n USING (normalized_venue)
""")
def upserted_venues(spark, d):
    """The venue cache after lookups, of which some worked out no travel."""
    return upserts.venues(_ask(spark, d, _OLD_VENUES, "customer"), _ask(spark, d, _NEW_VENUES, "customer"))


@query("""
WITH e AS (SELECT c_custkey AS submission_id, c_custkey - 1 AS matched_submission_id, 'identical' AS method, 0.99e0 AS confidence, 'old' AS first_detected_at, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS family_id FROM customer WHERE c_custkey % 3 != 0),
n AS (SELECT c_custkey AS submission_id, c_custkey - 2 AS matched_submission_id, 'changed' AS method, 0.8e0 AS confidence, 'new' AS first_detected_at, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 100 END AS family_id FROM customer WHERE c_custkey % 4 != 0)
SELECT submission_id, coalesce(n.matched_submission_id, e.matched_submission_id) AS matched_submission_id, coalesce(n.method, e.method) AS method, coalesce(n.confidence, e.confidence) AS confidence, coalesce(e.first_detected_at, n.first_detected_at) AS first_detected_at,
  coalesce(n.family_id, e.family_id) AS family_id FROM e FULL JOIN n USING (submission_id)
""")
def upserted_repeats(spark, d):
    """Findings of repeats after a later run: the first day and a known family stay."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    row = lambda back, method, confidence, at, family: [k.alias("submission_id"), (k - back).alias("matched_submission_id"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(at).alias("first_detected_at"), family.alias("family_id")]
    old = c.filter("c_custkey % 3 != 0").select(*row(1, "identical", 0.99, "old", F.when(k % 2 == 0, F.col("c_nationkey"))))
    return upserts.repeat_matches(old, c.filter("c_custkey % 4 != 0").select(*row(2, "changed", 0.8, "new", F.when(k % 5 == 0, F.col("c_nationkey") + 100))))


@query("""
WITH e AS (SELECT s_nationkey AS campus, lower(s_name) AS normalized_name, s_name AS name, s_acctbal AS latitude FROM supplier), n AS (
  SELECT s_nationkey AS campus, CASE WHEN l_orderkey % 3 = 0 THEN lower(s_name) WHEN l_orderkey % 3 = 1 THEN lower(s_name) || ' annex' ELSE '' END AS normalized_name, l_returnflag AS name, l_extendedprice AS latitude, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
last AS (SELECT * FROM n WHERE normalized_name != '' QUALIFY row_number() OVER (PARTITION BY campus, normalized_name ORDER BY seq DESC, name DESC, latitude DESC) = 1)
SELECT campus, normalized_name, coalesce(l.name, e.name) AS name, coalesce(l.latitude, e.latitude) AS latitude FROM e FULL JOIN last l USING (campus, normalized_name)
""")
def upserted_landmarks(spark, d):
    """Landmarks after a refresh that named some several times: the last one counts as a whole."""
    s = table(spark, d, "supplier")
    old = s.select(F.col("s_nationkey").alias("campus"), F.lower("s_name").alias("normalized_name"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("latitude"))
    key = F.when(F.col("l_orderkey") % 3 == 0, F.lower("s_name")).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lower("s_name"), F.lit(" annex"))).otherwise("")
    seen = table(spark, d, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    seen = seen.select(F.col("s_nationkey").alias("campus"), key.alias("normalized_name"), F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("latitude"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return upserts.landmarks(old, seen, "seq")


@query("""
SELECT n_nationkey AS category_id, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey END AS manual_priority, CASE WHEN n_nationkey % 3 != 0 AND p IS NOT NULL THEN p ELSE 7 END AS inferred_priority
FROM nation LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS p FROM supplier WHERE s_suppkey % 4 != 0 GROUP BY 1) ON s_nationkey = n_nationkey
""")
def inferred_priorities(spark, d):
    """Priorities estimated for categories, never where one was set by hand."""
    k = F.col("n_nationkey")
    own = table(spark, d, "nation").select(k.alias("category_id"), F.when(k % 3 == 0, F.col("n_regionkey")).alias("manual_priority"), F.lit(7).cast("long").alias("inferred_priority"))
    found = table(spark, d, "supplier").filter("s_suppkey % 4 != 0").select(F.col("s_nationkey").alias("category_id"), F.col("s_suppkey").cast("long").alias("priority"))
    return upserts.inferred_priorities(own, found)


_RECORD = """concat('{{"submission_id": ', {id}, CASE WHEN c_custkey % 13 = 12 THEN '' ELSE ', "title": "t"' END, ', "source_audience": "', CASE WHEN c_custkey % 13 = 7 THEN 'Parents' ELSE 'Both' END, '", "status": "',
  CASE WHEN c_custkey % 13 = 9 THEN 'Old' ELSE 'New' END, '", "full_body": "[{{x}}, y", "distribution_dates": ["2026-01-02"', CASE WHEN c_custkey % 13 = 10 THEN '' ELSE ', "2026-01-01"' END,
  '], "first_distribution_date": "2026-01-01", "source_query_membership": ["Employees"', CASE WHEN c_custkey % 13 = 11 THEN ', "Visitors"' ELSE '' END, ']}}')"""
_DAY = f"""CASE WHEN c_custkey % 17 = 0 THEN '[1' WHEN c_custkey % 19 = 0 THEN NULL ELSE concat('{{"schema_version": ', CASE WHEN c_custkey % 13 = 1 THEN '2' ELSE '1' END, ', "target_date": "', CASE WHEN c_custkey % 13 = 2 THEN '2026-1-1' ELSE '2026-01-01' END,
  '", "counts": {{"unique": ', CASE WHEN c_custkey % 13 = 3 THEN '3' ELSE '2' END, '}}, ', CASE WHEN c_custkey % 13 = 4 THEN '' ELSE '"source_counts": {{}}, ' END, '"category_registry": ', CASE WHEN c_custkey % 13 = 5 THEN '[]' ELSE '[{{"Id": 1}}]' END,
  ', "announcements": ', CASE WHEN c_custkey % 13 = 6 THEN '{{}}' ELSE concat('[', {_RECORD.format(id="c_custkey")}, ', ', {_RECORD.format(id="CASE WHEN c_custkey % 13 = 8 THEN c_custkey WHEN c_custkey % 26 = 0 THEN 0 ELSE c_custkey + 1 END")}, ']') END, ', "validation": {{}}}}') END""".replace("{{", "{").replace("}}", "}")
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"""
WITH docs AS (SELECT c_custkey, try_cast({_DAY} AS JSON) AS j FROM customer),
heads AS (SELECT c_custkey, j, array_to_string(list_filter({_LIST(S.ARTIFACT_KEYS)}, lambda k: NOT list_contains(json_keys(j), k)), ',') AS missing FROM docs),
parts AS (SELECT *, CASE WHEN json_type(j, '$.announcements') = 'ARRAY' THEN from_json(json_extract(j, '$.announcements'), '["JSON"]') END AS rs FROM heads),
each_one AS (SELECT c_custkey, unnest(rs) AS r, generate_subscripts(rs, 1) AS i, j ->> '$.target_date' AS day FROM parts),
faults AS (SELECT c_custkey, i, CASE WHEN NOT json_contains(json_keys(r)::JSON, '"title"') THEN 'announcement lacks title' WHEN NOT regexp_full_match(r ->> '$.submission_id', '0*[1-9][0-9]*') THEN 'bad submission_id'
  WHEN EXISTS (SELECT 1 FROM each_one o WHERE o.c_custkey = e.c_custkey AND o.i < e.i AND o.r ->> '$.submission_id' = e.r ->> '$.submission_id') THEN 'duplicate submission_id ' || (r ->> '$.submission_id')
  WHEN r ->> '$.source_audience' NOT IN ('Employees', 'Students', 'Both') THEN 'bad source_audience' WHEN r ->> '$.status' NOT IN ('New', 'Standing') THEN 'bad status'
  WHEN NOT list_contains(from_json(json_extract(r, '$.distribution_dates'), '["VARCHAR"]'), day) THEN 'the day isn''t among the dates of ' || (r ->> '$.submission_id')
  WHEN len(list_filter(from_json(json_extract(r, '$.source_query_membership'), '["VARCHAR"]'), lambda v: v NOT IN ('Employees', 'Students'))) > 0 THEN 'unknown view ' || list_filter(from_json(json_extract(r, '$.source_query_membership'), '["VARCHAR"]'), lambda v: v NOT IN ('Employees', 'Students'))[1] END AS fault FROM each_one e),
first AS (SELECT c_custkey, arg_min(fault, i) AS fault FROM faults WHERE fault IS NOT NULL GROUP BY 1)
SELECT c_custkey, CASE WHEN j IS NULL OR json_type(j) != 'OBJECT' THEN 'no JSON object' WHEN missing != '' THEN 'missing keys ' || missing WHEN j ->> '$.schema_version' != '1' THEN 'unsupported schema_version' WHEN length(j ->> '$.target_date') != 10 THEN 'bad target_date'
  WHEN json_type(j, '$.announcements') != 'ARRAY' THEN 'announcements is no list' WHEN json_array_length(j, '$.category_registry') = 0 THEN 'empty category registry' WHEN CAST(j ->> '$.counts.unique' AS INT) != len(rs) THEN 'counts.unique isn''t the number of announcements' ELSE fault END AS reject
FROM parts LEFT JOIN first USING (c_custkey)
""")
def stored_days(spark, d):
    """Why a stored day is refused, or null: the first fault of its JSON document."""
    rows = table(spark, d, "customer").select("c_custkey", F.expr(_DAY).alias("document"))
    return artifacts.checked(rows, "document").drop("document")


_SIZES = {
    "announcements": "SELECT 1 FROM documents", "versions": "SELECT DISTINCT user_id, event_type FROM events", "observations": "SELECT 1 FROM events", "daily_records": "SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events",
    "categories": "SELECT 1 FROM nation", "distribution_dates": "SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders", "runs": "SELECT DISTINCT CAST(ts AS DATE) FROM events", "deliveries": "SELECT DISTINCT CAST(ts AS DATE) FROM events WHERE event_type = 'purchase'",
    "dates_covered": "SELECT DISTINCT CAST(ts AS DATE) FROM events", "parking_locations": "SELECT 1 FROM part", "parking_aliases": "SELECT DISTINCT p_name, p_brand FROM part", "parking_sources": "SELECT DISTINCT p_type FROM part", "parking_unresolved": "SELECT 1 FROM part WHERE p_size > 40",
    "parking_landmarks": "SELECT 1 FROM supplier", "event_venues": "SELECT DISTINCT s_nationkey FROM supplier", "calendar_recommendations": "SELECT 1 FROM orders", "calendar_actions_offered": "SELECT 1 FROM orders WHERE o_orderstatus = 'F'", "repeat_matches": "SELECT 1 FROM customer WHERE c_acctbal < 0",
    "logical_families": "SELECT DISTINCT c_nationkey FROM customer", "logical_family_members": "SELECT 1 FROM customer", "display_status_corrections": "SELECT 1 FROM lineitem WHERE l_returnflag = 'R'", "extra_editions": "SELECT 1 FROM documents WHERE source = 'src1'",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM ({sql})" for name, sql in _SIZES.items()))
def all_statistics(spark, d):
    """Every count of a status document, in one job."""
    names = ("documents", "events", "nation", "orders", "part", "supplier", "customer", "lineitem")
    return digest.statistics({name: _ask(spark, d, sql, *names) for name, sql in _SIZES.items()})


_FACILITY = """CASE p_partkey % 5 WHEN 0 THEN concat('Lot ', CASE WHEN p_size % 2 = 0 THEN 'Q' ELSE 'RX' END, '-', p_size) WHEN 1 THEN concat('Parking  Lot ', 300 + p_size) WHEN 2 THEN concat('Tower ', p_size, ' Parking Garage') WHEN 3 THEN concat('Field ', p_size) ELSE concat('V', p_size, ' Lot') END"""


@query(f"""
WITH names AS (SELECT p_partkey, trim(regexp_replace({_FACILITY}, ' +', ' ', 'g')) AS name FROM part),
codes AS (SELECT *, upper(regexp_extract(name, '^(?:Parking )?Lot (.*)$', 1)) AS lot FROM names),
forms AS (SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN [name, 'Parking Lot ' || lot, 'Lot ' || lot, lot || ' Lot', lot]
  WHEN p_partkey % 5 = 2 THEN [name, name || ' Lot', 'Parking ' || name, name || ' Parking', replace(name, ' Parking', ''), name] ELSE [name, name || ' Lot', 'Parking ' || name, name || ' Parking'] END AS fs FROM codes),
each_one AS (SELECT p_partkey, unnest(fs) AS alias, generate_subscripts(fs, 1) AS i FROM forms),
keyed AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')) AS key FROM each_one)
SELECT p_partkey, alias, key FROM keyed QUALIFY row_number() OVER (PARTITION BY p_partkey, key ORDER BY i) = 1
""")
def facility_spellings(spark, d):
    """Every spelling under which a facility is looked up, with its key."""
    names = _ask(spark, d, f"SELECT p_partkey, {_FACILITY} AS name FROM part", "part")
    return names.select("p_partkey", F.inline(mentions.spellings(F.col("name"))))
