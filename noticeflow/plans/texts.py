"""Text queries on documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import text as T
from ..operators import ranking, repeats, timeline
from .registry import query, table

@query(r"""
SELECT digest, count(*)::BIGINT AS member_count, min(doc_id) AS canonical FROM (SELECT doc_id, sha256('v' || trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))) AS digest FROM documents) GROUP BY 1
""")
def content_hash_groups(spark, d):
    """Families of equal text: size and smallest member."""
    flat = F.trim(F.regexp_replace("text", r"[ \t\r\n\f]+", " "))
    rows = table(spark, d, "documents").select("doc_id", T.content_hash([flat]).alias("digest"))
    return repeats.families(rows, "digest", "doc_id").select("digest", "member_count", "canonical")


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_COMMON = ", ".join(f"'{w}'" for w in S.COMMON_WORDS)


@query(rf"""
SELECT doc_id, list_aggregate(list_sort(list_filter(list_distinct(string_split(trim(regexp_replace({_lower('text')}, '[^a-z0-9]+', ' ', 'g')), ' ')),
  lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains([{_COMMON}], w))), 'string_agg', ' ') AS own_words FROM documents
""")
def distinctive_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.nullif(F.array_join(T.distinctive_words(F.col("text")), " "), F.lit("")).alias("own_words"))


@query(r"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(CASE turn % 3 WHEN 0 THEN 'authorization=k' || conv_id || ' ' WHEN 1 THEN 'Bearer t' || conv_id || ', ' ELSE 'Authorization: bearer x; ' END || text, '[ \t\r\n\f\x0B]+', ' ', 'g')) AS x FROM conversations),
a AS (SELECT *, regexp_replace(x, '(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@', '\1[redacted]@', 'g') AS y FROM t),
b AS (SELECT *, regexp_replace(y, '(?i)\bauthorization\s*[:=]\s*bearer\s+[^\s,;]+', 'Authorization: Bearer [redacted]', 'g') AS z FROM a),
b2 AS (SELECT *, regexp_replace(z, '(?i)\bbearer\s+([^\[\s,;][^\s,;]*)', 'Bearer [redacted]', 'g') AS v FROM b),
c AS (SELECT *, regexp_replace(regexp_replace(v, '(?i)\b(access[_-]?token|api[_-]?key|credential|password|secret|token)\b\s*[=:]\s*[^\s,;]+', '[redacted]', 'g'), '(?i)\bauthorization\s*[=:]\s*([^bB\s,;][^\s,;]*)', '[redacted]', 'g') AS u FROM b2)
SELECT conv_id, turn, nullif(substr(regexp_replace(u, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[redacted-email]', 'g'), 1, 300), '') AS safe FROM c
""")
def redact_text(spark, d):
    """Conversations with a secret put before each text."""
    put = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("authorization=k"), "conv_id", F.lit(" "))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Bearer t"), "conv_id", F.lit(", "))).otherwise("Authorization: bearer x; ")
    return table(spark, d, "conversations").select("conv_id", "turn", T.redact(F.concat(put, F.col("text"))).alias("safe"))


@query(r"""
SELECT page_id, octet_length(encode(html))::BIGINT AS body_bytes, len(regexp_extract_all(html, '(?i)<img\b'))::INT AS image_count,
  len(regexp_extract_all(html, '(?i)href\s*=\s*["''][^"'']+["'']'))::INT AS link_count, len(regexp_extract_all(html, '(?i)src\s*=\s*["'']data:[^"'']*'))::INT AS data_uri_count FROM pages
""")
def body_metrics(spark, d):
    n = lambda p: F.coalesce(F.regexp_count("html", F.lit(p)), F.lit(0))
    return table(spark, d, "pages").select(
        "page_id", F.octet_length("html").cast("bigint").alias("body_bytes"), n(r"(?i)<img\b").alias("image_count"),
        n(r"""(?i)href\s*=\s*["'][^"']+["']""").alias("link_count"), n(r"""(?i)src\s*=\s*["']data:[^"']*""").alias("data_uri_count"),
    )


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1) AS u FROM pages),
p AS (SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) AS i FROM l), q AS (SELECT page_id, url, min(i) AS i FROM p GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS position, url FROM q
""")
def extract_urls(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(T.links(F.col("html"))).alias("position", "url"))
    return rows.select("page_id", (F.col("position") + 1).alias("position"), "url")


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '</t[dh]\s*>', ' ', 'gi'), '<br\s*/?>|</(p|div|li|tr|h[1-6]|ul|ol|table|section|article|blockquote)\s*>', chr(10), 'gi') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '<script\b.*?(</script\s*>|$)|<style\b.*?(</style\s*>|$)|<!--.*?-->', '', 'gis'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g') AS x FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(replace(x, chr(160), ' '), '[ \t\r\f\v]+', ' ', 'g'), '(?m)^ +| +$', '', 'g') AS x FROM c)
SELECT page_id, regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body_text FROM d
""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text("html").alias("body_text"))


@query()
def reposted_notices(spark, d):
    """Documents as notices: the first ten words are the title; copies posted again are found."""
    title = F.array_join(F.slice(F.split(F.trim(F.col("text")), r"\s+"), 1, 10), " ")
    no = lambda kind: F.lit(None).cast(kind)
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("submission_id"), title.alias("title"), F.col("text").alias("body_text"), no("string").alias("full_body"), no("bigint").alias("category_id"), F.col("lang").alias("source_audience"),
        F.lit(False).alias("is_event"), no("date").alias("event_date"), no("int").alias("event_start_min"), F.lit("a@example.org").alias("contact_email"), F.lit("a@example.org").alias("submitted_by_email"),
    )
    return repeats.find_repeats(rows, rows)


@query(f"""
WITH r AS (SELECT c_custkey AS id, c_custkey // 8 AS g, c_custkey % 8 AS k FROM customer WHERE c_custkey % 8 IN (0, 1, 4)),
p AS (SELECT a.id, a.g, min(b.id) AS other, arg_min(CASE WHEN (a.k = 4) = (b.k = 4) THEN 'identical' ELSE 'changed' END, b.id) AS method FROM r a JOIN r b ON a.g = b.g AND a.id <> b.id GROUP BY ALL)
SELECT id AS submission_id, other AS matched_submission_id, 'notice ' || g || '|1|Both' AS family_key, method, CASE method WHEN 'identical' THEN {S.CONFIDENCE["identical"]}::DOUBLE ELSE {S.CONFIDENCE["changed"]}::DOUBLE END AS confidence, 1.0::DOUBLE AS similarity, method = 'changed' AS materially_changed FROM p
""")
def reposted_copies(spark, d):
    """Eight notices made of each eight customers: the same, shouted, in another category, far longer, with another link, that from another sender, and two events of different days."""
    k, g = F.col("c_custkey") % 8, F.floor(F.col("c_custkey") / 8)
    body = F.concat(F.lit("The water of tank no "), g, F.lit(" is off from noon until further word"))
    link = F.when(k == 4, "https://b.example/x").when(k == 5, "https://c.example").when(k == 1, F.concat(F.lit("https://a.example/"), g, F.lit("/"))).otherwise(F.concat(F.lit("https://a.example/"), g))
    sender = F.when(k == 5, "b@example.org").otherwise("a@example.org")
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("submission_id"), F.concat(F.lit("Notice "), g).alias("title"), F.when(k == 1, F.concat(F.upper(body), F.lit("!"))).when(k == 3, F.concat_ws(". ", body, body)).otherwise(body).alias("body_text"),
        F.concat(F.lit('<a href="'), link, F.lit('">more</a>')).alias("full_body"), F.when(k == 2, 2).otherwise(1).cast("bigint").alias("category_id"), F.lit("Both").alias("source_audience"), (k >= 6).alias("is_event"),
        F.when(k >= 6, F.date_add(F.lit("2026-09-01").cast("date"), k.cast("int"))).alias("event_date"), F.when(k >= 6, 600).alias("event_start_min"), sender.alias("contact_email"), sender.alias("submitted_by_email"),
    )
    return repeats.find_repeats(rows, rows)


def _relevance_sql() -> str:
    def total(text, signals, scale=1.0):
        return " + ".join(f"CASE WHEN contains({text}, ' {p} ') THEN {w * scale!r}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in signals.items())

    def graded(signals):
        return " + ".join(f"CASE WHEN contains(i, ' {p} ') THEN {w!r}::DOUBLE WHEN contains(p, ' {p} ') THEN {w * S.PURPOSE_WEIGHT!r}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in signals.items())

    fold = lambda x: f"' ' || trim(regexp_replace({_lower(x)}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    return f"""
WITH t AS (SELECT doc_id, source, {fold("substr(text, 1, 60)")} AS i, {fold(f"substr(text, 1, {S.PURPOSE_CHARS})")} AS p, {fold(f"substr(text, {S.PURPOSE_CHARS + 1})")} AS b FROM documents),
s AS (SELECT doc_id, source = 'src1' AS wide, CASE source WHEN 'src2' THEN 0.30::DOUBLE WHEN 'src3' THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END AS cat, {total("i", S.IDENTITY_SIGNALS)} + {graded(S.TOPIC_SIGNALS)} AS topic, {graded(S.ROUTINE_SIGNALS)} AS routine, {graded(S.BREADTH_SIGNALS)} AS breadth,
  {total("b", S.TOPIC_SIGNALS, S.BODY_WEIGHT)} - ({total("b", S.ROUTINE_SIGNALS, S.BODY_WEIGHT)}) AS body FROM t)
SELECT doc_id, round(least(1, greatest(0, 0.3 + least(topic, 0.4) + greatest(-routine, -0.6) + least(breadth + CASE WHEN wide THEN 0.1 + CASE WHEN routine = 0 THEN 0.05 ELSE 0 END ELSE 0 END, 0.25) + cat
  + greatest(-0.1, least(0.1, body)))), 6)::DOUBLE AS score FROM s"""


@query(_relevance_sql())
def relevance_score(spark, d):
    """Documents as notices: the opening as title, a source for the widest audience, and one for each kind of category."""
    audience = F.when(F.col("source") == "src1", "Both").otherwise("Students")
    category = F.when(F.col("source") == "src2", "Official").when(F.col("source") == "src3", "Athletic Events")
    out = ranking.with_relevance(table(spark, d, "documents"), F.substring("text", 1, 60), F.col("text"), audience, category)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("""
SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS counters FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
""")
def json_counters(spark, d):
    return table(spark, d, "events").select("event_id", timeline.compact_counters(F.col("props")).alias("counters")).filter("counters != ''")


@query(r"""
SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 3500 THEN substr(text, 1, 3500) || '...' ELSE text END AS payload FROM documents
""")
def payload_projection(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"), T.clipped(F.col("text"), S.PAYLOAD_CHARS).alias("payload"))
