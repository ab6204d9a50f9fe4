"""Operators of the digest, its documents and its operations on the driver's tables.

Texts that the tables lack are put together from their columns by one SQL
expression, which both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, headings, mentions, moments, sessions
from ..functions import text as T
from ..operators import digest, quality, repeats
from .registry import query, table


@query("""
SELECT 'announcements' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'versions', count(*) FROM events UNION ALL SELECT 'dates_covered', count(DISTINCT ts::DATE) FROM events
UNION ALL SELECT 'offered', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'categories', count(*) FROM nation UNION ALL SELECT 'members', count(DISTINCT o_custkey) FROM orders
""")
def table_statistics(spark, d):
    events, orders = table(spark, d, "events"), table(spark, d, "orders")
    return digest.statistics({
        "announcements": table(spark, d, "documents"), "versions": events, "dates_covered": events.select(F.to_date("ts")).distinct(), "offered": orders.filter("o_orderstatus = 'F'"),
        "categories": table(spark, d, "nation"), "members": orders.select("o_custkey").distinct(),
    })


_MEMBERS = "SELECT user_id AS submission_id, 'f' || (user_id % 11) AS family_key FROM events GROUP BY user_id"
_SENT = "SELECT ts::DATE AS target_date FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) % 2 = 0"


@query(f"""
WITH m AS ({_MEMBERS}), daily AS (SELECT DISTINCT user_id AS submission_id, ts::DATE AS target_date FROM events), sent AS ({_SENT})
SELECT family_key, submission_id,
  (SELECT min(target_date) FROM daily d WHERE d.submission_id = m.submission_id AND EXISTS (SELECT 1 FROM sent s WHERE s.target_date = d.target_date)) AS first_delivered_date,
  (SELECT max(target_date) FROM daily d WHERE d.submission_id = m.submission_id AND EXISTS (SELECT 1 FROM sent s WHERE s.target_date = d.target_date)) AS last_delivered_date,
  submission_id = min(submission_id) OVER (PARTITION BY family_key) AS is_canonical FROM m
""")
def family_index(spark, d):
    events = table(spark, d, "events")
    members = events.select(F.col("user_id").alias("submission_id"), F.concat(F.lit("f"), F.col("user_id") % 11).alias("family_key")).distinct()
    days = events.filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("target_date")).count()
    sent = days.select("target_date", F.when(F.col("count") % 2 == 0, "sent").otherwise("prepared").alias("state"))
    return repeats.member_index(members, events.select(F.col("user_id").alias("submission_id"), F.to_date("ts").alias("target_date")), sent)


@query("""
SELECT f.n_regionkey AS family, c_custkey AS member, c_name AS title, s_name AS matched FROM customer JOIN nation f ON f.n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def family_members(spark, d):
    """Members of each family with a title where there is one."""
    nation, s = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("family")), table(spark, d, "supplier")
    rows = table(spark, d, "customer").join(nation, "c_nationkey").join(s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("matched")), "c_custkey", "left")
    return rows.select("family", F.col("c_custkey").alias("member"), F.col("c_name").alias("title"), "matched")


@query("SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def shortlist_bodies(spark, d):
    """Bodies are fetched for a shortlist of ids only."""
    wanted = table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    return table(spark, d, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("""
SELECT o_orderpriority AS category, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS members, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS kept FROM orders GROUP BY 1
""")
def category_tally(spark, d):
    """Rows of each category, and those left after a filter."""
    kept = F.sum(F.when(F.col("o_totalprice") > 100000, 1).otherwise(0)).cast("bigint")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("members"), kept.alias("kept"))


@query("""
SELECT n_name AS category, coalesce(try_cast(NULLIF(n_nationkey % 5, 3) AS INT), 999) AS priority, row_number() OVER (ORDER BY coalesce(NULLIF(n_nationkey % 5, 3), 999), n_name)::INT AS place FROM nation
""")
def category_listing(spark, d):
    """Categories by their priority, unplaced ones last; one partition, as the registry is small by nature."""
    from pyspark.sql import Window

    rows = table(spark, d, "nation").select(F.col("n_name").alias("category"), F.coalesce(F.nullif(F.col("n_nationkey") % 5, F.lit(3)), F.lit(999)).cast("int").alias("priority"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("priority", "category")))


_ITEMS = """SELECT o_orderkey AS submission_id, o_orderdate::DATE AS day, CASE WHEN o_orderstatus = 'O' THEN 'New' ELSE 'Standing' END AS status, (o_custkey % 4)::INT AS priority,
  o_orderpriority AS category, (o_custkey % 5)::INT AS rank, 'Order ' || o_orderkey AS title, md5(o_orderpriority || o_custkey) AS content FROM orders"""


def _items(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("submission_id"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "O", "New").otherwise("Standing").alias("status"),
        (F.col("o_custkey") % 4).cast("int").alias("priority"), F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 5).cast("int").alias("rank"),
        F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.md5(F.concat("o_orderpriority", "o_custkey")).alias("content"),
    )


@query(f"""
SELECT submission_id, day, dense_rank() OVER (PARTITION BY day ORDER BY priority, category)::INT AS "group", row_number() OVER (PARTITION BY day, priority, category ORDER BY rank, submission_id DESC)::INT AS position
FROM ({_ITEMS}) WHERE status = 'New'
""")
def display_groups(spark, d):
    return digest.display_groups(_items(spark, d), ["day"]).select("submission_id", "day", "group", "position")


@query(f"SELECT submission_id, day, row_number() OVER (PARTITION BY day ORDER BY rank, submission_id DESC)::INT AS position FROM ({_ITEMS}) WHERE status = 'Standing'")
def standing_display(spark, d):
    return digest.standing_order(_items(spark, d), ["day"]).select("submission_id", "day", "position")


@query(f"""
WITH t AS (SELECT day, title, row_number() OVER (PARTITION BY day ORDER BY rank, submission_id) AS n FROM ({_ITEMS})), j AS (SELECT day, string_agg(title, ' · ' ORDER BY n) AS line FROM t WHERE n <= 3 GROUP BY 1)
SELECT day, CASE WHEN length(line) > 40 THEN rtrim(substr(line, 1, 39)) || '…' ELSE line END AS preheader FROM j
""")
def preheader(spark, d):
    return digest.preheader(_items(spark, d), ["day"], ["rank", "submission_id"], limit=40)


@query(f"SELECT day, sha256(day::VARCHAR || '|' || string_agg(submission_id::VARCHAR || '=' || content, '|' ORDER BY submission_id)) AS digest FROM ({_ITEMS}) GROUP BY 1")
def digest_hash(spark, d):
    return digest.digest_hash(_items(spark, d), "day", "submission_id", "submission_id", "content")


@query("""
WITH e AS (SELECT user_id, ts, ts + to_minutes(floor(value % 30)::INT) AS done FROM events), o AS (SELECT user_id, coalesce(ts < lag(done) OVER (PARTITION BY user_id ORDER BY ts, done), false) AS over FROM e)
SELECT user_id, NOT bool_or(over) AS sequential FROM o GROUP BY 1
""")
def sequential_check(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(floor(value % 30) as int), 0)").alias("done"))
    return digest.sequential(rows, ["user_id"], "ts", "done")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, NULLIF(min(l_suppkey) % 4, 0) AS place FROM lineitem GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, place ORDER BY l_linenumber) AS n FROM l),
c AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS position FROM f WHERE n = 1) SELECT * FROM c WHERE position <= 3
""")
def callout_caps(spark, d):
    """A notice's callouts: one for each place, one unresolved; the cap is the feature."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.nullif(F.min("l_suppkey") % 4, F.lit(0)).alias("place"))
    return digest.callouts(rows, "l_orderkey", "place", "l_linenumber", most=3).select("l_orderkey", "l_linenumber", "position")


@query("""
SELECT c_custkey, s_suppkey AS garage FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 4000 GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1) ON s_nationkey = c_nationkey
""")
def sole_garage(spark, d):
    """The garage of a campus that has one only."""
    own = digest.sole(table(spark, d, "supplier").filter("s_acctbal > 4000"), "s_nationkey", "s_suppkey").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("garage"))
    return table(spark, d, "customer").join(own, "c_nationkey").select("c_custkey", "garage")


@query("""
WITH n AS (SELECT DISTINCT p_name AS needle FROM part), h AS (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_type AS name FROM part)
SELECT p_partkey, needle FROM h, n WHERE length(needle) >= 6 AND contains(' ' || name || ' ', ' ' || needle || ' ')
""")
def landmark_containment(spark, d):
    part = table(spark, d, "part")
    names = part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("name"))
    return digest.contained(part.select(F.col("p_name").alias("needle")).distinct(), names, "needle", "name").select("p_partkey", "needle")


@query("""
WITH h AS (SELECT c_custkey, c_nationkey AS hint, s_suppkey AS place, s_nationkey AS campus FROM customer JOIN supplier ON s_suppkey // 3 = c_custkey // 3 AND s_acctbal > 2000),
g AS (SELECT c_custkey, count(*) AS n, sum(CASE WHEN campus = hint THEN 1 ELSE 0 END) AS near, count(DISTINCT campus) AS campuses, min(place) AS a, min(CASE WHEN campus = hint THEN place END) AS b FROM h GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN a WHEN near = 1 THEN b WHEN campuses = 1 THEN a END AS place FROM g
""")
def venue_by_campus(spark, d):
    """Known places under a venue's key, those with a position only, and the one that the campus decides on."""
    places = table(spark, d, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("place"), F.col("s_nationkey").alias("campus"), F.expr("s_suppkey div 3").alias("k"))
    hits = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("hint"), F.expr("c_custkey div 3").alias("k")).join(places, "k")
    return digest.picked(hits, "c_custkey", "campus", "hint", "place")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def new_categories(spark, d):
    now = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return digest.unseen(now, table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey")


@query("""
WITH k AS (SELECT s_suppkey AS source_id, md5(s_name) AS old, TIMESTAMP '2020-01-01' AS last_changed FROM supplier), f AS (SELECT c_custkey + 3 AS source_id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN md5('Supplier#' || lpad((c_custkey + 3)::VARCHAR, 9, '0')) ELSE md5(c_name) END AS fp, c_custkey % 2 = 0 AS hand FROM customer)
SELECT coalesce(k.source_id, f.source_id) AS source_id, coalesce(fp, old) AS fingerprint, CASE WHEN fp IS NOT NULL AND fp IS DISTINCT FROM old THEN TIMESTAMP '2024-01-01' ELSE last_changed END AS last_changed,
  CASE WHEN fp IS NULL THEN 'failed' WHEN fp IS NOT DISTINCT FROM old THEN 'unchanged' WHEN coalesce(hand, false) AND old IS NOT NULL THEN 'review' ELSE 'changed' END AS status
FROM k FULL JOIN f ON k.source_id = f.source_id
""")
def source_refresh(spark, d):
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.md5("s_name").alias("fingerprint"), F.lit("2020-01-01").cast("timestamp").alias("last_changed"))
    c = table(spark, d, "customer")
    fp = F.when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("string")).when(F.col("c_custkey") % 3 == 0, F.md5(F.format_string("Supplier#%09d", F.col("c_custkey") + 3))).otherwise(F.md5("c_name"))
    fetched = c.select((F.col("c_custkey") + 3).alias("source_id"), fp.alias("fingerprint"), (F.col("c_custkey") % 2 == 0).alias("by_hand"))
    return digest.refreshed(known, fetched, F.lit("2024-01-01").cast("timestamp"))


@query("""
SELECT s_suppkey AS place_id, CASE WHEN c_custkey IS NULL OR c_custkey % 6 = 0 OR c_custkey % 4 = 0 THEN s_name ELSE c_name END AS name,
  CASE WHEN c_custkey IS NULL THEN 'note' WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 4 = 0 THEN 'note' ELSE 'name,note' END AS pins FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey
""")
def manual_overrides(spark, d):
    places = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("name"), F.array(F.lit("note")).alias("override_fields"))
    by_hand = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), (F.col("c_custkey") % 6 == 0).alias("clear"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"))
    out = digest.pinned(places, by_hand, ["name"])
    return out.select("place_id", "name", F.array_join(F.array_sort("override_fields"), ",").alias("pins"))


@query("""
SELECT coalesce(c.c_custkey, s.s_suppkey) AS id, coalesce(s_name, c_name) AS name FROM customer c FULL JOIN supplier s ON s_suppkey = c_custkey
""")
def association_upsert(spark, d):
    old, new = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return digest.last_wins(old, new, ["id"])


@query("""
SELECT k, sum(a)::BIGINT AS attempts, sum(b)::BIGINT AS calls FROM (SELECT c_nationkey AS k, 1 AS a, 0 AS b FROM customer UNION ALL SELECT s_nationkey, 1, 1 FROM supplier) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) GROUP BY 1
""")
def miss_counters(spark, d):
    row = lambda t, c, calls: table(spark, d, t).select(F.col(c).alias("k"), F.lit(1).alias("attempts"), F.lit(calls).alias("calls"))
    solved = table(spark, d, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("k"))
    return digest.misses(row("customer", "c_nationkey", 0), row("supplier", "s_nationkey", 1), solved, "k")


@query("SELECT o_orderkey AS run_id, o_custkey AS target, CASE WHEN n IS NULL THEN NULL ELSE last END AS completed_at, CASE WHEN n IS NULL THEN 'running' WHEN n > 3 THEN 'success' ELSE 'failed' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey")
def run_log(spark, d):
    starts = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("target"))
    ends = table(spark, d, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.when(F.count("*") > 3, "success").otherwise("failed").alias("status"), F.max("l_shipdate").alias("completed_at"))
    return digest.run_log(starts, ends)


@query("""SELECT ts::DATE AS day, '{"mentions":' || count(*) || ',"hits":' || sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) || ',"users":' || sum(user_id) || '}' AS metrics FROM events GROUP BY 1""")
def run_metrics(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return digest.run_metrics(rows, ["day"], {"mentions": F.lit(1), "hits": F.when(F.col("event_type") == "click", 1).otherwise(0), "users": F.col("user_id")})


@query("""
SELECT o_custkey, o_orderkey, n::INT AS n, substr('failed for user' || o_custkey || ' [redacted] ' || repeat('x', 300), 1, 300) AS error
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 10
""")
def status_snapshot(spark, d):
    """The newest ten runs of each target, errors scrubbed and clipped: the bounds are the feature."""
    error = F.concat(F.lit("failed for   user"), "o_custkey", F.lit(" token=abc123 "), F.repeat(F.lit("x"), F.lit(300)))
    runs = table(spark, d, "orders").select("o_custkey", "o_orderkey", error.alias("error"))
    return digest.snapshot(runs, ["o_custkey"], "o_orderkey")


@query("""
SELECT n_nationkey, CASE WHEN max(r) = 4 THEN 'failed' WHEN max(r) = 3 THEN 'degraded' WHEN max(r) = 2 THEN 'unknown' ELSE 'ok' END AS overall, coalesce(string_agg(CASE WHEN r > 1 THEN c_name || ': ' || coalesce(detail, 'no detail') END, '; ' ORDER BY c_name), '') AS problems
FROM (SELECT c_nationkey AS n_nationkey, c_name, CASE c_custkey % 7 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS r, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS detail FROM customer) GROUP BY 1
""")
def health_document(spark, d):
    state = F.when(F.col("c_custkey") % 7 == 0, "failed").when(F.col("c_custkey") % 7 == 1, "degraded").when(F.col("c_custkey") % 7 == 2, F.lit(None).cast("string")).otherwise("ok")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("name"), state.alias("state"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("detail"))
    return digest.health(rows, ["n_nationkey"])


@query("SELECT c_custkey, p.priority FROM customer LEFT JOIN (VALUES ('FURNITURE', 1), ('MACHINERY', 2), ('BUILDING', 3)) AS p(title, priority) ON title = c_mktsegment")
def category_priorities(spark, d):
    listed = digest.priority_map(spark, ["FURNITURE", "MACHINERY", "BUILDING"]).withColumnRenamed("title", "c_mktsegment")
    return table(spark, d, "customer").join(listed, "c_mktsegment", "left").select("c_custkey", "priority")


@query("SELECT page_id, md5('image ' || page_id) AS image FROM pages")
def inline_images(spark, d):
    """Images in a page's text come back as they went in."""
    page = F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(F.encode(F.concat(F.lit("image "), "page_id"), "UTF-8")), F.lit('">'))
    return table(spark, d, "pages").select("page_id", F.md5(digest.data_uris(page)[0]).alias("image"))


@query("""
SELECT page_id, sum(n) OVER (PARTITION BY page_id // 20 ORDER BY n, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 20000 AS fits FROM (SELECT page_id, octet_length(encode(html)) AS n FROM pages)
""")
def image_budget(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr("page_id div 20").alias("g"), F.octet_length("html").alias("n"))
    return digest.budget(rows, ["g"], ["n", "page_id"], "n", 20000).select("page_id", "fits")


_LINK = """CASE p_partkey % 9 WHEN 0 THEN '  http://h.example/' || p_partkey || '. ' WHEN 1 THEN '&nbsp;go.example.org/x' || p_partkey WHEN 2 THEN 'file://c/' || p_partkey WHEN 3 THEN '//cdn.example/' || p_partkey WHEN 4 THEN '/path/' || p_partkey
  WHEN 5 THEN '#top' WHEN 6 THEN 'javascript:x(1)' WHEN 7 THEN 'mailto:a@b.example' ELSE p_name END"""


@query(rf"""
WITH a AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace({_LINK}, '^(\s|&nbsp;)+', ''), '\s+$', ''), '[.,;]+$', '') AS h FROM part)
SELECT p_partkey, CASE WHEN h = '' OR h LIKE '#%' THEN NULL WHEN regexp_matches(h, '^(https?://|mailto:|tel:)') THEN h WHEN regexp_matches(h, '^[a-z]+:') THEN NULL WHEN h LIKE '//%' THEN 'https:' || h WHEN h LIKE '/%' THEN 'https://example.org' || h
  WHEN regexp_matches(h, '^[a-z0-9-]+(\.[a-z0-9-]+)+([/?#]|$)') THEN 'https://' || h END AS link FROM a
""")
def repaired_links(spark, d):
    return table(spark, d, "part").select("p_partkey", T.repaired_link(F.expr(_LINK)).alias("link"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'color:red;font-size:' || p_size || 'px' ELSE 'color:red' END AS style FROM part")
def kept_styles(spark, d):
    raw = F.concat(F.lit(" Color : red ; position:fixed;background:url(x);"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("font-size: "), "p_size", F.lit("px; width:"))).otherwise("font-size:expression (1)"))
    return table(spark, d, "part").select("p_partkey", T.kept_style(raw, ("color", "font-size", "width")).alias("style"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' and ' || upper(p_brand[1]) || p_brand[2:] AS title, p_name AS bare, 'https://example.org/notice/' || p_partkey AS url,
  substr(sha256(p_name), 1, 12) AS print, p_name || ' — ' || p_type || ', ' || p_brand || ' — x@y.example' AS line FROM part
""")
def small_text_rules(spark, d):
    """Title case, brackets off, the official address, a short fingerprint and a contact's line."""
    none = F.lit(None).cast("string")
    return table(spark, d, "part").select(
        "p_partkey", T.title_case(F.concat_ws("  ", "p_name", F.lit("and"), "p_brand")).alias("title"), T.without_brackets(F.concat(F.lit("- "), "p_name", F.lit(" (see below) ;"))).alias("bare"),
        F.concat(F.lit("https://example.org/notice/"), "p_partkey").alias("url"), T.fingerprint(F.col("p_name")).alias("print"), T.person_line(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit("x@y.example"), none).alias("line"),
    )


@query("""
SELECT event_id, ((h + 11) % 12 + 1) || ':' || lpad(minute(ts)::VARCHAR, 2, '0') || CASE WHEN h < 12 THEN ' a.m.' ELSE ' p.m.' END AS shown, CASE WHEN event_type = 'error' THEN NULL ELSE least(100, greatest(0, value - 100)) END::DOUBLE AS score,
  CASE WHEN value <= 60 THEN 'adjacent' WHEN value <= 150 THEN 'near' ELSE 'in the area' END AS band, (user_id % 4) >= 2 AS sure, date_diff('second', date_trunc('day', ts), date_trunc('second', ts))::BIGINT AS age FROM (SELECT *, hour(ts) AS h FROM events)
""")
def small_number_rules(spark, d):
    """Times of twelve hours, clamped scores, bands of nearness, confidence of at least medium and ages in seconds."""
    e = table(spark, d, "events")
    word = F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), (F.col("user_id") % 4 + 1).cast("int"))
    midnight = T.instant(F.date_format("ts", "yyyy-MM-dd'T'00:00:00"))
    return e.select(
        "event_id", T.clock(F.hour("ts") * 60 + F.minute("ts")).alias("shown"), T.clamped(F.when(F.col("event_type") != "error", F.col("value") - 100)).alias("score"), geo.band(F.col("value")).alias("band"),
        T.at_least(word, F.lit("medium")).alias("sure"), T.seconds_between(midnight, F.col("ts")).cast("bigint").alias("age"),
    )


@query("""
SELECT sha256('v' || o_custkey || chr(31) || coalesce('v' || NULLIF(o_orderstatus, 'P'), 'n') || chr(31) || 'v' || o_orderpriority || chr(31) || 'v' || o_orderdate::DATE) AS digest, count(*)::BIGINT AS n, min(o_orderkey) AS first FROM orders GROUP BY 1
""")
def record_versions(spark, d):
    """Records with equal fields and dates have one digest."""
    o = table(spark, d, "orders")
    r = F.struct("o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_orderpriority")
    rows = o.select("o_orderkey", T.record_hash(r, ["o_custkey", "o_orderstatus", "o_orderpriority"], F.array(F.to_date("o_orderdate"))).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' 3/4' WHEN 2 THEN p_name || ' gala' ELSE p_type || ' of  the ' || p_name END"


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 3 THEN p_type || ' of the ' || p_name END AS title FROM part""")
def accepted_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", T.accepted_title(F.expr(_TITLE), F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("title"))


_RECORDS = """SELECT o_orderkey AS submission_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Both' ELSE 'Students' END AS source_audience, CASE WHEN o_orderkey % 60 <> 0 THEN o_orderdate::DATE END AS day,
  CASE WHEN o_orderkey % 70 = 0 THEN ' ' ELSE o_orderpriority END AS title, CASE WHEN o_orderstatus = 'P' THEN 'Draft' ELSE 'Approved' END AS submitted_status, NULLIF(o_custkey % 40, 7) AS category_id FROM orders"""


@query(f"""
WITH r AS ({_RECORDS}), g AS (
SELECT 'V2 complete' AS rule, abs(count(DISTINCT submission_id) - 15000) AS detail, count(DISTINCT submission_id) = 15000 AS ok FROM r
UNION ALL SELECT 'V3 whole', CASE WHEN count(*) = 1500 THEN 13500 ELSE 0 END, count(*) <> 1500 FROM r
UNION ALL SELECT 'V4 audience', count(*), count(*) = 0 FROM r WHERE source_audience IS NULL
UNION ALL SELECT 'V5 date', count(*), count(*) = 0 FROM r WHERE day IS DISTINCT FROM DATE '1997-01-15'
UNION ALL SELECT 'V6 unique', count(*), count(*) = 0 FROM (SELECT submission_id FROM r GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'V6 positive', count(*), count(*) = 0 FROM r WHERE submission_id <= 0
UNION ALL SELECT 'V7 required', count(*), count(*) = 0 FROM r WHERE trim(title) = '' OR day IS NULL
UNION ALL SELECT 'V7 approved', count(*), count(*) = 0 FROM r WHERE submitted_status <> 'Approved'
UNION ALL SELECT 'V7 category', count(*), count(*) = 0 FROM r WHERE category_id IS NULL OR category_id NOT IN (SELECT n_nationkey FROM nation))
SELECT rule, 'Students' AS scope, ok, detail::BIGINT AS detail FROM g
""")
def announcement_gates(spark, d):
    """All gates of one audience, with nulls where values are needed."""
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 60 != 0, F.to_date("o_orderdate"))
    rows = o.select(
        F.col("o_orderkey").alias("submission_id"), F.when(F.col("o_orderkey") % 50 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 0, "Both").otherwise("Students").alias("source_audience"),
        F.array_compact(F.array(day)).alias("distribution_dates"), F.when(F.col("o_orderkey") % 70 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"), F.lit("body").alias("full_body"),
        F.when(F.col("o_orderstatus") == "P", "Draft").otherwise("Approved").alias("submitted_status"), F.nullif(F.col("o_custkey") % 40, F.lit(7)).alias("category_id"),
    )
    return quality.announcement_gates(rows, table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), 15000, "1997-01-15", "Students", page_size=1500)


@query("""
SELECT c_custkey AS submission_id, w AS warning FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'no contact email' END, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'event without a name' END, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 = 0 THEN 'event without a date' END], lambda x: x IS NOT NULL)) AS w FROM customer)
""")
def soft_warnings(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "submission_id")
    k = F.col("submission_id")
    rows = c.select("submission_id", F.when(k % 5 != 0, "a@b.example").alias("contact_email"), (k % 2 == 0).alias("is_event"), F.when(k % 3 == 0, " ").otherwise("x").alias("event_name"), F.when(k % 7 != 0, F.lit("2024-01-01").cast("date")).alias("event_date"))
    return quality.soft_warnings(rows)


@query("""
SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'balance' END, CASE WHEN s_nationkey > 20 THEN 'nation' END], lambda x: x IS NOT NULL), ',') AS broken FROM supplier WHERE s_acctbal < 0 OR s_nationkey > 20
""")
def record_constraints(spark, d):
    bad = quality.rejected_records(table(spark, d, "supplier"), {"balance": F.col("s_acctbal") >= 0, "nation": F.col("s_nationkey").between(0, 20)})
    return bad.select("s_suppkey", F.array_join("broken", ",").alias("broken"))


@query(r"""
SELECT conv_id, turn, NOT regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b|data:[a-z]+/') AS clean, regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[email removed]', 'g') AS shown FROM conversations
""")
def payload_cleanliness(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", quality.clean_payload(F.col("text")).alias("clean"), T.without_emails(F.col("text")).alias("shown"))


_PLACE = "CASE c_custkey % 5 WHEN 0 THEN 'Zoom' WHEN 1 THEN c_mktsegment || ' Hall (2nd floor)' WHEN 2 THEN NULL WHEN 3 THEN ' TBD. ' ELSE 'Room ' || c_custkey END"
_TALK = "CASE c_custkey % 4 WHEN 0 THEN 'Join us on Microsoft Teams' WHEN 1 THEN 'A talk in the hall' WHEN 2 THEN 'HYBRID meeting' ELSE 'Online and free' END"


@query(f"""
WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN c_mktsegment || ' Hall' WHEN 4 THEN 'Room ' || c_custkey END AS room, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, CASE WHEN k = 2 OR (k IN (0, 3) AND room IS NOT NULL) THEN 'hybrid' WHEN k IN (0, 3) THEN 'virtual' WHEN room IS NOT NULL THEN 'in_person' ELSE 'unknown' END AS mode, room, CASE k WHEN 0 THEN 'Microsoft Teams' WHEN 3 THEN 'Online' END AS detail FROM x
""".replace("'Online' END AS detail", "'Virtual' END AS detail"))
def attendance_modes(spark, d):
    return table(spark, d, "customer").select("c_custkey", sessions.attendance(F.expr(_TALK), F.expr(_PLACE)).alias("a")).select("c_custkey", "a.*")


_NOTICE = """CASE c_custkey % 6 WHEN 0 THEN 'Park in Lot ' || chr(cast(65 + c_custkey % 20 as int)) || '-' || cast(c_custkey % 9 as string) || ' or the Maple Hall Parking Garage.' WHEN 1 THEN 'Lots B, C2 and D are closed; use Lot ' || cast(300 + c_custkey % 9 as string) || '.'
  WHEN 2 THEN 'Enter from the Parking Garage.' WHEN 3 THEN 'A lot of students came, a lot A.' WHEN 4 THEN 'Meet at juniper court lot, Lot C2' END"""


@query("""
WITH n AS (SELECT c_custkey AS id, c_custkey % 6 AS k, chr((65 + c_custkey % 20)::INT) AS letter, (c_custkey % 9)::VARCHAR AS digit, (300 + c_custkey % 9)::VARCHAR AS number, CASE WHEN c_nationkey < 12 THEN 'north' ELSE 'south' END AS hint FROM customer),
m AS (SELECT id, hint, 'Lot ' || letter || '-' || digit AS matched_text, 'lot ' || lower(letter) || ' ' || digit AS k1 FROM n WHERE k = 0 UNION ALL SELECT id, hint, 'Maple Hall Parking Garage', 'maple hall garage' FROM n WHERE k = 0
  UNION ALL SELECT id, hint, 'Lot B', 'lot b' FROM n WHERE k = 1 UNION ALL SELECT id, hint, 'Lot C2', 'lot c 2' FROM n WHERE k = 1 UNION ALL SELECT id, hint, 'Lot D', 'lot d' FROM n WHERE k = 1 UNION ALL SELECT id, hint, 'Lot ' || number, 'lot ' || number FROM n WHERE k = 1
  UNION ALL SELECT id, hint, 'the Parking Garage', 'parking garage' FROM n WHERE k = 2 UNION ALL SELECT id, hint, 'Juniper Court Lot', 'juniper court lot' FROM n WHERE k = 4 UNION ALL SELECT id, hint, 'Lot C2', 'lot c 2' FROM n WHERE k = 4),
p AS (SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 2 = 0 THEN 'north' ELSE 'south' END AS campus, CASE s_suppkey % 5 WHEN 0 THEN 'lot b' WHEN 1 THEN 'lot c 2' WHEN 2 THEN 'maple hall garage' WHEN 3 THEN 'lot 30' || (s_suppkey % 9) ELSE 'juniper court lot' END || CASE WHEN s_suppkey < 12 THEN '' ELSE ' annex ' || s_suppkey END AS alias FROM supplier),
h AS (SELECT id, matched_text, hint, campus, place_id, max((campus = hint)::INT) OVER (PARTITION BY id, matched_text) AS same FROM m JOIN p ON alias = k1), o AS (SELECT id, matched_text, count(DISTINCT place_id) AS c, min(place_id) AS place_id FROM h WHERE same = 0 OR campus = hint GROUP BY 1, 2)
SELECT m.id, m.matched_text, CASE WHEN c = 1 THEN place_id END AS place_id, CASE WHEN c IS NULL THEN 'unknown' WHEN c > 1 THEN 'ambiguous' ELSE 'resolved' END AS reason FROM m LEFT JOIN o ON o.id = m.id AND o.matched_text = m.matched_text
""")
def mention_links(spark, d):
    """Notices made of each customer: mentions, their first key that is known, and the campus that decides between places."""
    from ..operators import places

    notices = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(_NOTICE).alias("body"), F.when(F.col("c_nationkey") < 12, "north").otherwise("south").alias("campus_hint"))
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    alias = F.when(k % 5 == 0, "lot b").when(k % 5 == 1, "lot c 2").when(k % 5 == 2, "maple hall garage").when(k % 5 == 3, F.concat(F.lit("lot 30"), k % 9)).otherwise("juniper court lot")
    alias = F.concat(alias, F.when(k < 12, "").otherwise(F.concat(F.lit(" annex "), k)))
    aliases = s.select(alias.alias("alias"), F.when(k % 2 == 0, "north").otherwise("south").alias("campus"), k.alias("place_id"))
    found = mentions.mentions(notices, "id", "body", {"juniper court lot": "Juniper Court Lot"}).join(notices.select("id", "campus_hint"), "id")
    found = found.withColumn("mention_id", F.concat_ws("|", "id", "matched_text"))
    return found.join(places.resolve(found, aliases), "mention_id").select("id", "matched_text", "place_id", "reason")


_SCHEDULE = """CASE c_custkey % 5 WHEN 0 THEN 'Come on September ' || cast(10 + c_custkey % 15 as string) || ' from ' || cast(8 + c_custkey % 3 as string) || ':00 a.m. to 11:30 a.m.' WHEN 1 THEN 'Every Monday 9:00 - 10:00' WHEN 2 THEN 'Register by September 7th. Limited to 10-12 people'
  WHEN 3 THEN concat('10/', cast(1 + c_custkey % 20 as string), '/2026 at 1-2 p.m.', chr(10), 'October 28, 1:30 - 3:00') END"""


@query("""
SELECT c_custkey, make_date(2026, 9, (10 + c_custkey % 15)::INT) AS event_date, (8 + c_custkey % 3)::INT * 60 AS start_min, 690 AS end_min, 1 AS session_index, 1 AS session_count FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, make_date(2026, 10, (1 + c_custkey % 20)::INT), 780, 840, 1, 2 FROM customer WHERE c_custkey % 5 = 3
UNION ALL SELECT c_custkey, DATE '2026-10-28', 810, 900, 2, 2 FROM customer WHERE c_custkey % 5 = 3
""")
def sessions_from_text(spark, d):
    """Notices made of each customer through the extraction of sessions."""
    rows = table(spark, d, "customer").select("c_custkey", F.expr(_SCHEDULE).alias("body"))
    return sessions.sessions(rows, "c_custkey", "body", F.lit("2026-09-01").cast("date"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '09-' || (10 + c_custkey % 15) WHEN 2 THEN '09-07' WHEN 3 THEN '10-28,2026-10-' || lpad((1 + c_custkey % 20)::VARCHAR, 2, '0') ELSE '' END AS days, c_custkey % 5 = 1 AS recurring,
  CASE c_custkey % 5 WHEN 0 THEN (8 + c_custkey % 3)::INT * 60 WHEN 1 THEN 540 WHEN 3 THEN 810 END::INT AS first_time FROM customer
""")
def named_days(spark, d):
    """The days that a notice names, whether it recurs, and its first time of day."""
    body = F.expr(_SCHEDULE)
    return table(spark, d, "customer").select("c_custkey", F.array_join(moments.date_tokens(body), ",").alias("days"), F.coalesce(moments.recurs(body), F.lit(False)).alias("recurring"), moments.first_time(moments.folded(F.regexp_replace(body, "\n", " "))).alias("first_time"))


@query("""
SELECT c_custkey, 'location' AS label, c_mktsegment || ' Hall' || chr(10) || 'second line' AS value FROM customer UNION ALL SELECT c_custkey, 'who', 'All ' || c_nationkey FROM customer WHERE c_custkey % 2 = 0
""")
def labelled_blocks(spark, d):
    body = "concat('Opening', chr(10), 'LOCATION: ', c_mktsegment, '  Hall', chr(10), 'second line', chr(10), chr(10), 'Closing words', chr(10), case when c_custkey % 2 = 0 then concat('Who: All ', c_nationkey, chr(10), 'and more') else '' end)"
    return sessions.labelled_fields(table(spark, d, "customer").select("c_custkey", F.expr(body).alias("body")), "c_custkey", "body")


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN p_partkey % 2 = 0 THEN [p_name || ' garage', p_name, p_name || ' parking garage'] ELSE ['lot ' || p_name, p_name, 'parking lot ' || p_name, p_name || ' lot'] END)), '|') AS aliases FROM part
""")
def generated_aliases(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", F.lit("Parking Garage"))).otherwise(F.concat_ws(" ", F.lit("Lot"), "p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(mentions.aliases(name)), "|").alias("aliases"))


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE trim(text) = '' OR text IS NULL OR source = 'src1'")
def missing_descriptions(spark, d):
    """Rows without a text, and those of a campus that is asked for."""
    rows = table(spark, d, "documents")
    return rows.filter(F.col("text").isNull() | (F.trim("text") == "") | (F.col("source") == "src1")).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT c_mktsegment, min(last) AS oldest, count(*) FILTER (WHERE last IS NULL)::BIGINT AS never FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def verification_summary(spark, d):
    """The oldest verified place of each kind, and how many never were."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = table(spark, d, "customer").join(last, "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.min("last").alias("oldest"), F.sum(F.col("last").isNull().cast("bigint")).alias("never"))


@query("""
WITH daily AS (SELECT DISTINCT user_id AS submission_id, ts::DATE AS target_date FROM events) SELECT submission_id, target_date, (SELECT count(*) FROM daily p WHERE p.submission_id = d.submission_id AND p.target_date < d.target_date)::BIGINT AS prior_appearances FROM daily d
""")
def prior_appearances(spark, d):
    from ..operators import history

    daily = table(spark, d, "events").select(F.col("user_id").alias("submission_id"), F.to_date("ts").alias("target_date")).distinct()
    none = spark.createDataFrame([], "target_date date, state string")
    return history.appearances(daily, none).drop("previous_deliveries")


@query("""
SELECT o_orderkey AS submission_id, CASE WHEN o_orderstatus = 'O' AND s_suppkey IS NOT NULL THEN 'Standing' WHEN o_orderstatus = 'O' THEN 'New' ELSE 'Standing' END AS display_status, o_totalprice > 200000 OR coalesce(s_nationkey > 12, false) AS changed FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey
""")
def applied_repeats(spark, d):
    """The status that is shown once repeats are known; what changed stays changed."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("submission_id"), F.when(F.col("o_orderstatus") == "O", "New").otherwise("Standing").alias("status"), (F.col("o_totalprice") > 200000).alias("changed"))
    matches = table(spark, d, "supplier").select(F.col("s_suppkey").alias("submission_id"), (F.col("s_nationkey") > 12).alias("materially_changed"))
    return repeats.applied(rows, matches).select("submission_id", "display_status", "changed")


_SAID = """CASE p_partkey % 8 WHEN 1 THEN 'Too short here' WHEN 2 THEN 'Behind the garage at 39.712 next to the hall there' WHEN 3 THEN 'A convenient surface lot next to the hall on the hill'
  WHEN 4 THEN concat('See https://x.example/', p_partkey, ' for the lot next to the hall') WHEN 5 THEN 'Directly across from the Quartz Tower near the lot' WHEN 6 THEN concat('Just  north of Maple Hall, between the ', p_name, ' shop and Larch Street.') WHEN 7 THEN repeat('long ', 31) END"""


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'length' WHEN 2 THEN 'coordinate' WHEN 3 THEN 'praise' WHEN 4 THEN 'address' WHEN 5 THEN 'unknown name' WHEN 7 THEN 'length' END AS fault FROM part")
def grounded_descriptions(spark, d):
    """Descriptions of places whose names stand in the evidence, and why others are refused."""
    evidence = F.array(F.lit("Maple Hall"), F.lit("Larch Street"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", T.description_fault(F.expr(_SAID), evidence).alias("fault"))


_INVITES = """CASE c_custkey % 5 WHEN 0 THEN 'Talk in Maple-Hall today' WHEN 1 THEN 'Come to the main campus, north side' WHEN 2 THEN 'From the North Side to the harbor campus' WHEN 4 THEN 'Maple Hall and Alder Annex, harbor campus' END"""


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_custkey % 5 IN (0, 1) THEN 'north' WHEN c_custkey % 5 = 4 THEN 'south' END AS campus,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'category' ELSE ['building', 'keyword', 'conflict', 'none', 'keyword'][c_custkey % 5 + 1] END AS evidence FROM customer
""")
def inferred_campus(spark, d):
    """The campus of notices made of each customer."""
    from ..operators import places

    small = lambda rows: spark.createDataFrame(rows, "name string, campus string")
    notices = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"), F.expr(_INVITES).alias("body"))
    names = small([("maple hall", "north"), ("Alder Annex", "south")])
    keywords = small([("main campus", "north"), ("north side", "north"), ("harbor campus", "south")])
    return places.campus_of(notices, small([("BUILDING", "north")]).withColumnRenamed("name", "category"), names, keywords, "c_custkey", "body", "category")


_OFFERED = """CASE c_custkey % 8 WHEN 0 THEN concat('Thursday, September 10 from 11:00-12:30', chr(10), 'October ', cast(1 + c_custkey % 20 as string), ' from 2:30-4:00') WHEN 1 THEN 'September 10 and October 2' WHEN 2 THEN 'Soon'
  WHEN 3 THEN concat('Date: September ', cast(10 + c_custkey % 15 as string), chr(10), 'Time: 9:00 - 10:00, 10:30 - 11:00') WHEN 4 THEN 'September 10. Every Monday 9:00-10:00' WHEN 5 THEN concat('September 10', chr(10), '9:00-11:00', chr(10), '10:00-12:00')
  WHEN 6 THEN 'Register by September 10, 9:00-10:00' END"""


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 8 AS k, c_nationkey AS n FROM customer), held(k, reason, evidence) AS (VALUES (1, 'multiple_distinct_dates', 'event_language'), (2, 'no_event_date', 'event_language'),
  (4, 'recurring_schedule', 'body_date,body_time_range,event_language'), (5, 'overlapping_time_blocks', 'body_date,body_time_range,event_language'), (6, 'deadline_not_event', 'body_date,body_time_range,event_language'))
SELECT c_custkey, DATE '2026-09-10' AS event_date, 660 AS start_min, 750 AS end_min, 1 AS session_index, 2 AS session_count, 'body_date,body_time_range,event_language,multi_session_schedule,session_time_ranges,weekday_confirmed' AS evidence, NULL AS reason FROM c WHERE k = 0
UNION ALL SELECT c_custkey, make_date(2026, 10, (1 + c_custkey % 20)::INT), 870, 960, 2, 2, 'body_date,body_time_range,event_language,multi_session_schedule,session_time_ranges,weekday_confirmed', NULL FROM c WHERE k = 0
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, evidence, reason FROM c JOIN held USING (k)
UNION ALL SELECT c_custkey, make_date(2026, 9, (10 + c_custkey % 15)::INT), 540, 660, 1, 1, 'body_date_labelled,event_language,labelled_body_schedule,labelled_time_range', NULL FROM c WHERE k = 3
UNION ALL SELECT c_custkey, DATE '2026-09-11', 480 + n, CASE WHEN n % 2 = 0 THEN 600 END, 1, 1, 'event_language,source_event_date,source_event_flag,source_event_start_time,source_time_block', NULL FROM c WHERE k = 7
""")
def event_series(spark, d):
    """Workshops made of each customer: their sessions, or what holds them back."""
    stated = F.col("c_custkey") % 8 == 7
    rows = table(spark, d, "customer").select(
        "c_custkey", F.lit("Workshop").alias("title"), F.expr(_OFFERED).alias("body_text"), stated.alias("is_event"), F.when(stated, F.lit("2026-09-11").cast("date")).alias("event_date"),
        F.when(stated, 480 + F.col("c_nationkey")).cast("int").alias("event_start_min"), F.when(stated & (F.col("c_nationkey") % 2 == 0), 600).alias("event_end_min"),
    )
    return sessions.series(rows, "c_custkey", F.lit("2026-09-01").cast("date"))


_PAGE = """CASE p_partkey % 6 WHEN 0 THEN concat('<h2>', upper(p_name), '!</h2><p>', p_type, '</p>') WHEN 1 THEN concat('<div><div><b>', p_name, '</b></div></div>', p_type) WHEN 2 THEN concat('<p><a href="x">', p_name, '</a></p>', p_type)
  WHEN 3 THEN concat('<p>', p_name, ' again</p>', p_type) WHEN 4 THEN concat(p_type, '<h1>', p_name, '</h1>') END"""
_PLAIN = "CASE p_partkey % 3 WHEN 0 THEN concat(upper(p_name), ':', chr(10), chr(10), p_type) WHEN 1 THEN concat(p_type, chr(10), p_name) END"


@query(f"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '<p>' || p_type || '</p>' WHEN 1 THEN p_type ELSE coalesce({_PAGE}, '') END AS page, CASE p_partkey % 3 WHEN 0 THEN p_type ELSE coalesce({_PLAIN}, '') END AS plain FROM part
""")
def repeated_headings(spark, d):
    """Bodies made of each part without an opening that repeats the title."""
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", headings.without_heading(F.expr(_PAGE), name).alias("page"), headings.without_first_line(F.expr(_PLAIN), name).alias("plain"))
