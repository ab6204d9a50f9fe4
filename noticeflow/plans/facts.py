"""Joins, gates, history and ranking on the driver's tables.

An order stands for a day's fact about its customer, an event for a record seen
on a day; a day counts as delivered if its number of purchases is even.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history, quality, ranking, timeline
from .registry import query, table

_DAILY = "SELECT DISTINCT user_id AS submission_id, ts::DATE AS target_date FROM events"
_SENT = "SELECT ts::DATE AS target_date FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) % 2 = 0"


def _daily(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("submission_id"), F.to_date("ts").alias("target_date")).distinct()


def _deliveries(spark, d):
    days = table(spark, d, "events").filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("target_date")).count()
    return days.select("target_date", F.when(F.col("count") % 2 == 0, "sent").otherwise("prepared").alias("state"))


@query("""
SELECT o_orderkey, o_custkey, c_name, coalesce(n_name, 'none') AS n_name,
  coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem WHERE l_orderkey = o_orderkey)), '') AS views,
  (row_number() OVER w - 1)::BIGINT AS prior_appearances,
  coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS previous_deliveries,
  CASE WHEN o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) THEN 'New' ELSE 'Standing' END AS status
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def digest_join(spark, d):
    """Facts with their version, category, source views and earlier appearances."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    views = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("views"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    facts = orders.select(
        "o_orderkey", "o_custkey", (F.row_number().over(w) - 1).cast("bigint").alias("prior_appearances"),
        F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).over(before), F.lit(0)).cast("bigint").alias("previous_deliveries"),
        F.when(F.col("o_orderdate") == F.min("o_orderdate").over(Window.partitionBy("o_custkey")), "New").otherwise("Standing").alias("status"),
    )
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.coalesce("n_name", F.lit("none")).alias("n_name"))
    return facts.join(named, "o_custkey").join(views, "o_orderkey", "left").select("o_orderkey", "o_custkey", "c_name", "n_name", F.coalesce("views", F.lit("")).alias("views"), "prior_appearances", "previous_deliveries", "status")


@query(f"""
WITH daily AS ({_DAILY}), sent AS ({_SENT})
SELECT d.submission_id, d.target_date,
  (SELECT count(*) FROM daily p WHERE p.submission_id = d.submission_id AND p.target_date < d.target_date)::BIGINT AS prior_appearances,
  (SELECT count(*) FROM daily p WHERE p.submission_id = d.submission_id AND p.target_date < d.target_date AND EXISTS (SELECT 1 FROM sent s WHERE s.target_date = p.target_date))::BIGINT AS previous_deliveries
FROM daily d
""")
def previous_deliveries(spark, d):
    return history.appearances(_daily(spark, d), _deliveries(spark, d))


@query(f"""
WITH daily AS ({_DAILY}), sent AS ({_SENT})
SELECT submission_id, min(target_date) AS first_delivered_date, max(target_date) AS last_delivered_date, count(*)::BIGINT AS delivered_days
FROM daily WHERE target_date < DATE '2024-01-25' AND target_date IN (SELECT target_date FROM sent) GROUP BY 1
""")
def delivered_history(spark, d):
    import datetime

    return history.delivered_history(_daily(spark, d), _deliveries(spark, d), datetime.date(2024, 1, 25))


_KINDS = ("click", "view", "purchase")


@query("SELECT ts::DATE AS day, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, " + ", ".join(f"sum(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END)::BIGINT AS n_{k}" for k in _KINDS) + " FROM events GROUP BY 1")
def day_counts(spark, d):
    return timeline.day_counts(table(spark, d, "events"), F.to_date("ts"), list(_KINDS), "event_type")


@query("""
SELECT user_id, CASE WHEN bool_or(event_type = 'click') AND bool_or(event_type = 'view') THEN 'both' WHEN bool_or(event_type = 'click') THEN 'click'
  WHEN bool_or(event_type = 'view') THEN 'view' ELSE 'none' END AS label FROM events GROUP BY 1
""")
def view_parity(spark, d):
    return quality.label_parity(table(spark, d, "events"), "user_id", "event_type", "click", "view")


@query("""
SELECT 'completeness' AS rule, 'all' AS scope, p = t AS ok, abs(p - t)::BIGINT AS detail
FROM (SELECT sum(n)::BIGINT AS p FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)), (SELECT count(*)::BIGINT AS t FROM orders)
""")
def crossfoot_gate(spark, d):
    orders = table(spark, d, "orders")
    return quality.cross_foot(orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), "n", orders.agg(F.count("*").alias("n")), "n")


@query("""
SELECT 'positive id' AS rule, 'all' AS scope, count(*) = 0 AS ok, count(*)::BIGINT AS detail FROM orders WHERE coalesce(o_orderkey <= 0, true)
UNION ALL SELECT 'required', 'all', count(*) = 0, count(*)::BIGINT FROM orders WHERE o_orderstatus IS NULL OR o_totalprice IS NULL
UNION ALL SELECT 'unique id', 'all', count(*) = 0, count(*)::BIGINT FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'category', 'all', count(*) = 0, count(*)::BIGINT FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def row_gates(spark, d):
    orders = table(spark, d, "orders")
    return quality.gates(
        quality.gate(orders, "positive id", F.coalesce(F.col("o_orderkey") <= 0, F.lit(True))),
        quality.gate(orders, "required", F.col("o_orderstatus").isNull() | F.col("o_totalprice").isNull()),
        quality.gate(quality.duplicates(orders, "o_orderkey"), "unique id", F.lit(True)),
        quality.gate(quality.orphans(orders, table(spark, d, "customer"), "o_custkey", "c_custkey"), "category", F.lit(True)),
    )


@query("SELECT l_orderkey, l_partkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return quality.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def orphan_fk(spark, d):
    good = table(spark, d, "supplier").filter("s_acctbal > 0")
    return quality.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), good, "l_suppkey", "s_suppkey")


@query("""
SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'repeated' FROM labels GROUP BY 1 HAVING count(*) > 1
""")
def permutation_check(spark, d):
    return quality.permutation(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("""
SELECT user_id, day, CASE WHEN day = min(day) OVER (PARTITION BY user_id) THEN 'New' ELSE 'Standing' END AS status FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events)
""")
def new_vs_standing(spark, d):
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    dates = days.groupBy("user_id").agg(F.collect_set("day").alias("dates"))
    return days.join(dates, "user_id").select("user_id", "day", ranking.status(F.col("dates"), F.col("day")).alias("status"))


def _items(spark, d):
    """Orders as items: priority from the segment's digit, change, event date a week on, extra edition."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("submission_id"), F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("manual"),
        (F.col("o_orderstatus") == "O").alias("changed"), (F.col("o_totalprice") > 400000).alias("extra_edition"), F.col("o_custkey"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 40).cast("int")).alias("event_date"),
    )
    o = o.withColumn("priority", ranking.priority(F.when(F.col("manual") < 5, F.col("manual")), F.lit(None).cast("int")))
    return o.withColumn("proximity", ranking.proximity(F.col("event_date"), F.col("day")))


_ITEMS = """
SELECT o_orderkey AS submission_id, o_orderdate::DATE AS day, o_custkey, o_orderstatus = 'O' AS changed, o_totalprice > 400000 AS extra_edition,
  CASE WHEN try_cast(substr(o_orderpriority, 1, 1) AS INT) < 5 THEN try_cast(substr(o_orderpriority, 1, 1) AS INT) ELSE 900 END AS priority,
  greatest(0, 30 - (o_custkey % 40))::INT AS proximity FROM orders
"""


@query(f"""
SELECT submission_id, day, priority, row_number() OVER (PARTITION BY day, priority ORDER BY extra_edition DESC, changed DESC, proximity DESC, submission_id DESC)::INT AS rank FROM ({_ITEMS})
""")
def rank_new(spark, d):
    return ranking.rank_new(_items(spark, d), ["day", "priority"]).select("submission_id", "day", "priority", "rank")


@query(f"""
WITH s AS (SELECT submission_id, day, round(greatest(0.0::DOUBLE, 120.0::DOUBLE - priority * 3.0::DOUBLE) + greatest(0.0::DOUBLE, 20.0::DOUBLE - (submission_id % 25)) + CASE WHEN changed THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END
   + proximity + CASE WHEN o_custkey % 3 = 0 THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END - 2.0::DOUBLE * (o_custkey % 7) + CASE WHEN extra_edition THEN 200.0::DOUBLE ELSE 0.0::DOUBLE END, 2) AS score FROM ({_ITEMS}))
SELECT submission_id, day, score, row_number() OVER (PARTITION BY day ORDER BY score DESC, submission_id DESC)::INT AS rank FROM s
""")
def rank_standing(spark, d):
    rows = _items(spark, d).withColumns({"days_old": F.col("submission_id") % 25, "audience": F.when(F.col("o_custkey") % 3 == 0, "Both").otherwise("Students"), "prior_appearances": F.col("o_custkey") % 7})
    return ranking.rank_standing(rows, ["day"]).select("submission_id", "day", "score", "rank")


@query("""
SELECT l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey, l_extendedprice FROM lineitem)) WHERE n = 1
""")
def argmax_match(spark, d):
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice").distinct()
    return ranking.best_candidate(pairs, "l_partkey", "l_extendedprice", "l_suppkey")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def top_recent(spark, d):
    """The newest ten: a report whose feature is the limit."""
    return table(spark, d, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def last_success(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return timeline.last_where(rows, F.col("event_type") == "purchase", F.col("event_id"), ["user_id"]).select("user_id", "event_id", "value")


@query("""
WITH first AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)
SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS changed FROM first
""")
def scd2_versions(spark, d):
    """A version for each content of a key at its first sight; a return to an earlier one is none."""
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return history.versions(rows, "user_id", "event_type", "event_id", "event_id")


@query("""
WITH e AS (SELECT c_custkey AS id, c_acctbal AS first, c_acctbal AS last, c_mktsegment AS seg FROM customer),
n AS (SELECT o_custkey + 1 AS id, min(o_totalprice) AS first, max(o_totalprice) AS last, NULL AS seg FROM orders GROUP BY 1)
SELECT coalesce(e.id, n.id) AS id, CASE WHEN e.id IS NULL THEN n.first WHEN n.id IS NULL THEN e.first ELSE least(e.first, n.first) END AS first,
  CASE WHEN e.id IS NULL THEN n.last WHEN n.id IS NULL THEN e.last ELSE greatest(e.last, n.last) END AS last, coalesce(e.seg, n.seg) AS seg
FROM e FULL JOIN n ON e.id = n.id
""")
def merge_snapshot(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("first"), F.col("c_acctbal").alias("last"), F.col("c_mktsegment").alias("seg"))
    n = table(spark, d, "orders").groupBy((F.col("o_custkey") + 1).alias("id")).agg(F.min("o_totalprice").alias("first"), F.max("o_totalprice").alias("last"), F.lit(None).cast("string").alias("seg"))
    return history.merge_snapshot(e, n, ["id"], {"first": history.smallest, "last": history.largest, "seg": history.preserve})


@query("SELECT event_id, user_id, max((value > 400)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INT AS changed FROM events")
def sticky_changed(spark, d):
    rows = table(spark, d, "events")
    return history.sticky(rows, ["user_id"], ["ts", "event_id"], F.col("value") > 400, "changed").select("event_id", "user_id", "changed")


@query("""
SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
WHERE n <= 3 OR o_orderdate >= TIMESTAMP '1998-06-01'
""")
def retention_keep(spark, d):
    rows = table(spark, d, "orders")
    recent = F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp")
    return history.retained(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, recent).select("o_orderkey", "o_custkey")


@query("SELECT r_name, string_agg(n_name, ' | ' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def group_concat(spark, d):
    both = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " | ").alias("names"))


@query("""
SELECT DISTINCT s_suppkey, n_name FROM supplier, nation WHERE n_nationkey = s_nationkey OR n_name = s_name OR n_regionkey = s_suppkey
""")
def or_lookup_distinct(spark, d):
    """A lookup by any of three keys, as a union of equi-joins."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    hits = [s.join(n, on).select("s_suppkey", "n_name") for on in (F.col("n_nationkey") == F.col("s_nationkey"), F.col("n_name") == F.col("s_name"), F.col("n_regionkey") == F.col("s_suppkey"))]
    return hits[0].union(hits[1]).union(hits[2]).distinct()


@query("""
WITH e AS (SELECT user_id, ts, ts + to_minutes(floor(value % 90)::INT) AS done FROM events),
f AS (SELECT *, CASE WHEN max(done) OVER w IS NULL OR ts > max(done) OVER w + INTERVAL 60 MINUTES THEN 1 ELSE 0 END AS fresh FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, done ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, done ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
SELECT user_id, island::BIGINT AS island, min(ts) AS phase_start, max(done) AS phase_end, count(*)::BIGINT AS n FROM g GROUP BY 1, 2
""")
def merge_phases(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(floor(value % 90) as int), 0)").alias("done"))
    return timeline.merged_phases(rows, ["user_id"], "ts", "done")


@query("""
SELECT c_custkey, CASE WHEN max(o_orderdate) IS NULL THEN NULL ELSE date_diff('day', max(o_orderdate)::DATE, DATE '1998-08-02') > 180 END AS stale
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def staleness(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return rows.select("c_custkey", timeline.stale(F.to_date("last"), F.to_date(F.lit("1998-08-02"))).alias("stale"))


@query("""
SELECT c_mktsegment, count(*)::BIGINT AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS negative, count(DISTINCT c_nationkey)::BIGINT AS nations, max(c_acctbal) AS most FROM customer GROUP BY 1
""")
def reference_statistics(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).cast("bigint").alias("negative"), F.countDistinct("c_nationkey").alias("nations"), F.max("c_acctbal").alias("most"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def unplaced_categories(spark, d):
    placed = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return table(spark, d, "nation").join(placed, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def delivery_gate(spark, d):
    """What hasn't been sent yet."""
    sent = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(sent, "o_orderkey", "left_anti")
