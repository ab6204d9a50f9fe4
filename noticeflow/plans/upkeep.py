"""Past days looked at again, corrections, and families that keep their ids, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups, recheck
from .facts import _DAILY, _SENT, _daily, _deliveries
from .registry import query, table

@query(f"""
WITH daily AS ({_DAILY}), sent AS ({_SENT}), first AS (SELECT submission_id, min(target_date) AS f FROM daily GROUP BY 1),
delivered AS (SELECT submission_id, min(target_date) AS f FROM daily JOIN sent USING (target_date) GROUP BY 1),
stored AS (SELECT d.*, CASE WHEN submission_id % 13 = 0 THEN NULL WHEN target_date = f.f OR submission_id % 7 = 0 THEN 'New' ELSE 'Standing' END AS display_status FROM daily d JOIN first f USING (submission_id) WHERE submission_id % 17 != 0),
fresh AS (SELECT d.*, CASE WHEN s.f < target_date THEN 'Standing' ELSE 'New' END AS display_status FROM daily d LEFT JOIN delivered s USING (submission_id)),
both_sides AS (SELECT f.submission_id, f.target_date, s.display_status AS p, f.display_status AS c, s.submission_id IS NULL AS added FROM fresh f LEFT JOIN stored s USING (submission_id, target_date))
SELECT submission_id, target_date, 'display_status' AS field, p AS previous, c AS current FROM both_sides WHERE p IS DISTINCT FROM c
UNION ALL SELECT submission_id, target_date, 'row', NULL, 'present' FROM both_sides WHERE added
""")
def rechecked_outcomes(spark, d):
    """What each stored day shows against what it should by the deliveries known then."""
    daily = _daily(spark, d)
    first = daily.groupBy("submission_id").agg(F.min("target_date").alias("__first"))
    shown = F.when(F.col("submission_id") % 13 != 0, F.when((F.col("target_date") == F.col("__first")) | (F.col("submission_id") % 7 == 0), "New").otherwise("Standing"))
    stored = daily.filter("submission_id % 17 != 0").join(first, "submission_id").select("submission_id", "target_date", shown.alias("display_status"))
    return recheck.changes(stored, recheck.outcomes(daily, _deliveries(spark, d)), ["submission_id", "target_date"], ["display_status"])


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, o_orderstatus FROM orders)
SELECT o.o_orderkey, o.o_custkey, o.day AS o_orderdate, arg_max(p.o_orderstatus, (p.day, p.o_orderstatus, p.o_orderkey)) AS known_o_orderstatus, arg_max(p.o_orderkey, (p.day, p.o_orderstatus, p.o_orderkey)) AS known_o_orderkey
FROM o LEFT JOIN o p ON p.o_custkey = o.o_custkey AND p.day + 30 <= o.day GROUP BY ALL
""")
def known_then(spark, d):
    """Each order with the customer's latest one that was known, a month late, on its day."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderstatus")
    versions = orders.select("o_custkey", F.date_add("o_orderdate", 30).alias("seen"), "o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("padded"), "o_orderkey")
    rows = recheck.as_known(orders.drop("o_orderstatus"), versions, "o_custkey", "o_orderdate", "seen", ["o_orderstatus", "padded", "o_orderkey"])
    return rows.drop("known_padded")


_RECORDED = """SELECT o_custkey AS k, 'o_orderstatus' AS field, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'X' END AS previous, o_orderstatus AS current, o_orderkey::INT AS n, o_orderdate AS corrected_at FROM orders WHERE o_orderkey % 2 = 0"""


@query(f"""
WITH recorded AS ({_RECORDED}), last AS (SELECT * FROM recorded QUALIFY row_number() OVER (PARTITION BY k ORDER BY corrected_at DESC, n DESC) = 1),
old AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'X' END AS s FROM customer),
new AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
found AS (SELECT old.k, old.s AS previous, new.s AS current FROM old JOIN new ON new.k = old.k WHERE old.s IS DISTINCT FROM new.s)
SELECT f.k, 'o_orderstatus' AS field, f.previous, f.current, (coalesce((SELECT max(n) FROM recorded r WHERE r.k = f.k), 0) + 1)::INT AS n
FROM found f LEFT JOIN last l ON l.k = f.k WHERE l.k IS NULL OR l.previous IS DISTINCT FROM f.previous OR l.current IS DISTINCT FROM f.current
""")
def display_corrections(spark, d):
    """Corrections that an audit lacks: old and new image of each changed field, numbered on from those there."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    recorded = orders.filter("o_orderkey % 2 = 0").select(
        F.col("o_custkey").alias("k"), F.lit("o_orderstatus").alias("field"), F.when(F.col("o_orderkey") % 3 != 0, "X").alias("previous"), F.col("o_orderstatus").alias("current"),
        F.col("o_orderkey").cast("int").alias("n"), F.col("o_orderdate").alias("corrected_at"),
    )
    new = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"))
    old = customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, "X").alias("o_orderstatus")).join(new.select("k"), "k", "left_semi")
    found = recheck.changes(old, new, ["k"], ["o_orderstatus"])
    return recheck.corrected(found, recorded, ["k"], F.lit("again"), F.lit(None).cast("timestamp")).drop("reason", "corrected_at")


#: Findings of a first and of a later run: an order repeats an earlier one of a customer nearby.
_PAIRS = """SELECT c_custkey AS submission_id, c_custkey - 1 - c_nationkey % 3 AS matched_submission_id, concat('title', CAST(c_custkey % 900 AS {text}), '|', CAST(c_nationkey AS {text}), '|Both') AS family_key,
  CASE WHEN c_custkey % 2 = 0 THEN 'identical' ELSE 'changed' END AS method, CASE WHEN c_custkey % 2 = 0 THEN 0.99e0 ELSE 0.8e0 END AS confidence FROM customer WHERE c_custkey > 4 AND c_custkey % 5 < {of}"""
_CONTENT = "SELECT c_custkey AS submission_id, c_name AS content_hash FROM customer WHERE c_custkey % 11 != 0"


def _sql_families(name: str, links: str) -> str:
    return f"""{name}_links AS ({links}), {name}_both AS (SELECT * FROM {name}_links UNION SELECT b, a FROM {name}_links UNION SELECT a, a FROM {name}_links UNION SELECT b, b FROM {name}_links),
{name}_reach AS (SELECT a AS member, b AS other FROM {name}_both UNION SELECT r.member, l.b FROM {name}_reach r JOIN {name}_both l ON l.a = r.other),
{name}_found AS (SELECT member, min(other) AS root FROM {name}_reach GROUP BY 1)"""


_LINKS = "SELECT submission_id AS a, matched_submission_id AS b FROM {p} UNION SELECT submission_id, min(least(submission_id, matched_submission_id)) OVER (PARTITION BY family_key) FROM {p}"


@query(f"""
WITH RECURSIVE p1 AS ({_PAIRS.format(of=2, text="VARCHAR")}), p2 AS ({_PAIRS.format(of=4, text="VARCHAR")}), {_sql_families("one", _LINKS.format(p="p1"))},
{_sql_families("two", _LINKS.format(p="p2") + " UNION SELECT member, root FROM one_found")},
ids AS (SELECT t.root, coalesce(min(o.root), t.root) AS family_id FROM two_found t LEFT JOIN one_found o USING (member) GROUP BY t.root),
content AS ({_CONTENT}),
best AS (SELECT s AS submission_id, max(m) AS matched, max(confidence) AS confidence, arg_max(method, confidence) AS method FROM (
  SELECT submission_id AS s, matched_submission_id AS m, confidence, method FROM p2 UNION ALL SELECT matched_submission_id, NULL, confidence, method FROM p2) GROUP BY 1)
SELECT family_id, t.member AS submission_id, b.matched AS matched_submission_id, c.content_hash, b.confidence, b.method,
  CASE WHEN o.member IS NOT NULL THEN DATE '2026-01-05' ELSE DATE '2026-02-05' END AS first_seen, DATE '2026-02-05' AS last_seen, t.member = min(t.member) OVER (PARTITION BY family_id) AS is_canonical,
  count(*) OVER (PARTITION BY family_id) AS member_count
FROM two_found t JOIN ids USING (root) LEFT JOIN one_found o ON o.member = t.member LEFT JOIN content c ON c.submission_id = t.member LEFT JOIN best b ON b.submission_id = t.member
""")
def backfilled_families(spark, d):
    """Families of two runs, the second with pairs that join some of the first's: members with their durable ids."""
    customer = table(spark, d, "customer")
    customer.createOrReplaceTempView("customer_of_families")
    ask = lambda sql: spark.sql(sql.replace("FROM customer", "FROM customer_of_families"))
    content = ask(_CONTENT)
    none = spark.createDataFrame([], "family_id long, submission_id long, matched_submission_id long, content_hash string, confidence double, method string, first_seen date, last_seen date")
    _, first, _ = groups.backfilled(ask(_PAIRS.format(of=2, text="STRING")), content, none, "2026-01-05")
    families, members, _ = groups.backfilled(ask(_PAIRS.format(of=4, text="STRING")), content, first.drop("is_canonical"), "2026-02-05")
    return members.join(families.select("family_id", "member_count"), "family_id")
