"""A day's enrichment, mentions, run windows and data addresses on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators import enrichment, mention_ladder, run_windows
from ..sources import generations, stores
from ..functions import payloads
from .registry import query, table


def _first_number(text: str | None) -> int:
    """A row's own number, from its text; a poisoned one has none."""
    found = "".join(c for c in (text or "")[-3:] if c in "0123456789")
    if not found:
        raise ValueError("no number in " + repr((text or "")[-3:]))
    if found.startswith("9"):
        raise KeyError(int(found))
    return int(found)


_OUTCOMES = """
WITH steps AS (SELECT o_orderkey, o_custkey, regexp_replace(right(coalesce(c_comment_text, ''), 3), '[^0-9]', '', 'g') AS digits, right(coalesce(c_comment_text, ''), 3) AS tail, o_totalprice FROM (
  SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN concat('order ', 'abc') ELSE concat('order ', CAST(o_custkey AS VARCHAR)) END AS c_comment_text FROM orders)),
judged AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'withheld' WHEN digits = '' OR digits LIKE '9%' OR CAST(digits AS BIGINT) = 0 OR o_totalprice < 50000 THEN CASE WHEN digits != '' AND NOT digits LIKE '9%' AND CAST(digits AS BIGINT) != 0 THEN 'withheld' ELSE 'failed' END ELSE 'done' END AS state,
  CASE WHEN o_orderkey % 4 = 0 THEN 'number' WHEN digits = '' OR digits LIKE '9%' THEN 'number' WHEN CAST(digits AS BIGINT) = 0 THEN 'share' WHEN o_totalprice < 50000 THEN 'offer' END AS step,
  CASE WHEN o_orderkey % 4 = 0 THEN 'not an event' WHEN digits = '' THEN 'ValueError: no number in ''' || tail || '''' WHEN digits LIKE '9%' THEN 'KeyError: ' || CAST(CAST(digits AS BIGINT) AS VARCHAR) WHEN CAST(digits AS BIGINT) = 0 THEN 'no share' WHEN o_totalprice < 50000 THEN 'below the threshold' END AS reason,
  digits, o_totalprice FROM steps)
"""


def _day(spark, d):
    text = F.when(F.col("o_orderkey") % 17 != 0, F.when(F.col("o_orderkey") % 5 == 0, F.lit("order abc")).otherwise(F.concat(F.lit("order "), F.col("o_custkey").cast("string"))))
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", text.alias("text"))
    return enrichment.enriched(rows, [
        enrichment.Step("number", enrichment.guarded(_first_number, LongType(), "text"), withheld=F.when(F.col("o_orderkey") % 4 == 0, "not an event")),
        enrichment.Step("share", F.try_divide(F.lit(1000), F.col("number")).cast("int"), fault=F.when(F.col("number") == 0, "no share")),
        enrichment.Step("offer", F.col("share") + 1, withheld=F.when(F.col("o_totalprice") < 50000, "below the threshold")),
    ])


@query(_OUTCOMES + "SELECT o_orderkey, state, step, reason, CASE WHEN state = 'done' THEN CAST(trunc(1000 / CAST(digits AS BIGINT)) AS INT) + 1 END AS offer FROM judged")
def day_enrichment(spark, d):
    """What became of each of a day's rows: a poisoned one costs itself only."""
    return _day(spark, d).select("o_orderkey", "state", "step", "reason", "offer")


@query(_OUTCOMES + "SELECT state, step, reason, count(*)::BIGINT AS n FROM judged GROUP BY ALL")
def enrichment_counters(spark, d):
    return enrichment.counters(_day(spark, d))


_PLACES = """SELECT concat('lot ', CAST(p_partkey % 50 AS {text})) AS alias, concat('p', CAST(p_partkey % 70 AS {text})) AS place_id, CAST(p_partkey % 70 % 3 AS {text}) AS campus, CASE p_partkey % 70 % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS confidence,
  CASE WHEN p_partkey % 70 % 11 != 0 THEN 40e0 + p_partkey % 70 END AS latitude, -75e0 AS longitude, CASE WHEN p_partkey % 70 % 13 != 0 THEN 'near the hall' ELSE '' END AS description, p_partkey % 70 % 31 = 0 AS garage FROM part WHERE p_partkey {which}"""
_MENTIONS = """SELECT o_orderkey AS mention_id, {keys} AS lookup_keys, o_orderkey % 23 = 0 AS bare, o_orderkey % 7 = 0 AS weak, CASE WHEN o_orderkey % 3 != 0 THEN CAST(o_custkey % 4 AS {text}) END AS hint FROM orders"""
_KEYS = ("concat('lot ', CAST(o_custkey % 90 AS {text}))", "concat('lot ', CAST(o_custkey % 45 AS {text}))")


@query(f"""
WITH mentions AS ({_MENTIONS.format(keys="[" + ", ".join(k.format(text="VARCHAR") for k in _KEYS) + "]", text="VARCHAR")}),
cat AS (SELECT DISTINCT * FROM ({_PLACES.format(text="VARCHAR", which="% 50 < 30")})), ref AS (SELECT DISTINCT * FROM ({_PLACES.format(text="VARCHAR", which="% 50 BETWEEN 30 AND 40")})),
keys AS (SELECT mention_id, hint, unnest(lookup_keys) AS alias, unnest([0, 1]) AS pos FROM mentions WHERE NOT bare),
found AS (
  SELECT mention_id, hint, 0 AS rung, pos, place_id, campus, confidence, latitude, longitude, description FROM keys JOIN cat USING (alias)
  UNION ALL SELECT mention_id, hint, 1, pos, place_id, campus, confidence, latitude, longitude, description FROM keys JOIN ref USING (alias)
  UNION ALL SELECT DISTINCT mention_id, hint, 0, 0, place_id, campus, confidence, latitude, longitude, description FROM mentions JOIN cat ON cat.garage AND cat.campus = hint WHERE bare
),
first AS (SELECT * FROM found QUALIFY dense_rank() OVER (PARTITION BY mention_id ORDER BY rung, pos) = 1),
near AS (SELECT * FROM first f WHERE campus = hint OR NOT EXISTS (SELECT 1 FROM first g WHERE g.mention_id = f.mention_id AND g.campus = g.hint)),
one AS (SELECT mention_id, count(DISTINCT place_id) AS n, min(rung) AS rung, min(place_id) AS place_id, min(campus) AS campus, min(confidence) AS confidence, min(latitude) AS latitude, min(longitude) AS longitude, min(description) AS description FROM near GROUP BY 1),
judged AS (SELECT m.*, o.* EXCLUDE (mention_id), CASE WHEN bare AND (n IS NULL OR n > 1) THEN 'ambiguous' WHEN n IS NULL AND weak THEN 'ignored' WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN NOT bare AND coalesce(confidence, '') NOT IN ('medium', 'high') THEN 'low_confidence'
  WHEN latitude IS NULL OR coalesce(description, '') = '' THEN 'incomplete' ELSE 'resolved' END AS outcome FROM mentions m LEFT JOIN one o USING (mention_id)),
told AS (SELECT mention_id, bare, outcome, CASE WHEN outcome = 'resolved' THEN CASE WHEN bare THEN 'sole_garage' WHEN rung = 1 THEN 'refresh' ELSE 'catalogue' END END AS method, CASE WHEN outcome = 'resolved' THEN place_id END AS place_id,
  CASE WHEN outcome IN ('resolved', 'low_confidence', 'incomplete') THEN campus ELSE hint END AS campus FROM judged)
SELECT mention_id, outcome, method, place_id, campus, CASE WHEN outcome = 'resolved' THEN 'place' WHEN outcome = 'ignored' OR (bare AND outcome = 'ambiguous') THEN NULL WHEN campus IN ('0', '1') THEN 'https://maps.example/' || campus ELSE 'https://maps.example/all' END AS url FROM told
""")
def mention_callouts(spark, d):
    """Every rung and every refusal of the ladder."""
    for t in ("orders", "part"):
        table(spark, d, t).createOrReplaceTempView(f"ladder_{t}")
    ask = lambda sql: spark.sql(sql.replace("FROM orders", "FROM ladder_orders").replace("FROM part", "FROM ladder_part"))
    mentions = ask(_MENTIONS.format(keys="array(" + ", ".join(k.format(text="STRING") for k in _KEYS) + ")", text="STRING"))
    links = spark.createDataFrame([("0", "https://maps.example/0"), ("1", "https://maps.example/1"), (None, "https://maps.example/all")], "campus string, url string")
    found = mention_ladder.callouts(mentions, ask(_PLACES.format(text="STRING", which="% 50 < 30")), ask(_PLACES.format(text="STRING", which="% 50 BETWEEN 30 AND 40")), links)
    return found.withColumn("url", F.when(F.col("outcome") == "resolved", F.when(F.col("url").isNotNull(), "place")).otherwise(F.col("url")))


_ZONES = "CASE event_id % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Berlin' WHEN 2 THEN 'UTC' ELSE 'Nowhere/Else' END"


@query(f"""
WITH rows AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2026-03-07 12:00:00' ELSE TIMESTAMP '2026-10-24 00:00:00' END + to_seconds(event_id * 977 % 2000000) AS now, {_ZONES} AS zone, (event_id % 5)::INT AS hour, (event_id % 2 * 30)::INT AS minute FROM events
),
walls AS (SELECT *, CASE WHEN zone != 'Nowhere/Else' THEN timezone(CASE WHEN zone != 'Nowhere/Else' THEN zone ELSE 'UTC' END, timezone('UTC', now)) END AS wall FROM rows),
due AS (SELECT *, CAST(CASE WHEN date_part('hour', wall) * 60 + date_part('minute', wall) >= hour * 60 + minute THEN wall ELSE wall - INTERVAL 1 DAY END AS DATE) AS day FROM walls),
named AS (SELECT *, CASE WHEN zone != 'Nowhere/Else' THEN zone ELSE 'UTC' END AS z FROM due), later AS (SELECT *, timezone(z, day + to_minutes(hour * 60 + minute)) AS inst FROM named),
since AS (SELECT *, CASE WHEN zone != 'Nowhere/Else' THEN timezone('UTC', CASE WHEN timezone(z, inst - INTERVAL 1 HOUR) = timezone(z, inst) THEN inst - INTERVAL 1 HOUR ELSE inst END) END AS window_start FROM later)
SELECT event_id, window_start, CASE WHEN window_start IS NULL OR event_id % 13 = 0 THEN 'unknown' WHEN now - to_minutes(CAST(event_id % 3000 AS BIGINT)) < window_start THEN 'stale' ELSE 'fresh' END AS staleness FROM since
""")
def run_window_staleness(spark, d):
    """Whether a snapshot is older than the last run that was due, around the days when clocks change."""
    start = F.when(F.col("event_id") % 2 == 0, F.lit("2026-03-07 12:00:00")).otherwise("2026-10-24 00:00:00").cast("timestamp")
    rows = table(spark, d, "events").select("event_id", F.timestamp_add("SECOND", (F.col("event_id") * 977 % 2000000).cast("int"), start).alias("now"), F.expr(_ZONES).alias("zone"))
    since = run_windows.window_start(F.col("now"), F.col("zone"), (F.col("event_id") % 5).cast("int"), (F.col("event_id") % 2 * 30).cast("int"))
    generated = F.when(F.col("event_id") % 13 != 0, F.timestamp_add("MINUTE", -(F.col("event_id") % 3000).cast("int"), F.col("now")))
    rows = rows.withColumn("window_start", since)
    return rows.select("event_id", "window_start", run_windows.staleness(generated, F.col("window_start")).alias("staleness"))


@query("""
WITH seen AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'error' WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'ok' ELSE 'error' END END AS observed FROM orders),
oks AS (SELECT *, coalesce(max(CASE WHEN observed = 'ok' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_ok FROM seen)
SELECT o_orderkey, o_custkey, CASE WHEN n >= 3 THEN 'failed' WHEN n > 0 THEN 'degraded' WHEN observed = 'ok' THEN 'ok' ELSE 'unknown' END AS state
FROM (SELECT a.*, (SELECT count(*) FROM seen b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey > a.last_ok AND b.o_orderkey <= a.o_orderkey AND b.observed = 'error') AS n FROM oks a)
""")
def component_states(spark, d):
    """Each component's state after each observation."""
    seen = F.when(F.col("o_orderstatus") == "O", "error").when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 3 == 0, "ok").otherwise("error"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", seen.alias("observed"))
    return run_windows.component_states(rows, "o_custkey", "o_orderkey", "observed").drop("observed")


@query("""
WITH made AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE left(text, 50) || '+%' || left(text, 9) END AS body FROM documents)
SELECT doc_id, md5(coalesce(body, '')) AS payload, octet_length(encode(coalesce(body, '')))::INT AS n_bytes, doc_id % 2 = 0 AS base64 FROM made
""")
def data_payloads(spark, d):
    """Data addresses of both kinds, put together from texts, come back byte for byte."""
    docs = table(spark, d, "documents")
    body = F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.substring("text", 1, 50), F.lit("+%"), F.substring("text", 1, 9))), F.lit(""))
    percent = F.replace(F.regexp_replace(F.regexp_replace(F.replace(F.url_encode(body), F.lit("+"), F.lit("%20")), "%2B", "+"), "%25(?![0-9A-Fa-f]{2})", "%"), F.lit("*"), F.lit("%2a"))
    address = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:text/plain;BASE64,"), F.base64(F.encode(body, "UTF-8")))).otherwise(F.concat(F.lit("data:text/plain;charset=utf-8,"), percent))
    page = F.concat(F.lit("<p><img alt='x' src=\""), address, F.lit("\">"))
    found = payloads.data_bytes(F.get(payloads.data_addresses(page), F.lit(0)))
    return docs.select("doc_id", F.md5(found).alias("payload"), F.octet_length(found).alias("n_bytes"), (F.col("doc_id") % 2 == 0).alias("base64"))


@query("SELECT o_custkey, count(*)::BIGINT AS n, max(o_orderkey) AS latest, true AS pointed FROM orders GROUP BY 1")
def published_snapshot(spark, d):
    """A snapshot published as a generation and read back after its check."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("latest"))
    path = stores.scratch_folder(spark, "published")
    name = generations.publish(rows, path)
    found = generations.read(spark, path, rows.schema, deep=True)
    return found.rows.withColumn("pointed", F.lit(found.generation == name and not found.passed_over))
