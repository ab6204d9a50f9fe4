"""Pairs turned into groups with durable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stores


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """member, root: the smallest member that each member of the pairs is linked to over any number of pairs.

    Stars in turns: each node's larger neighbours, then its smaller ones, move
    to its smallest.  A turn is one minimum for each node and one join, so a
    node of very many pairs is no group in a task; turns grow with the logarithm
    of a chain's length.
    """
    edges = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    alone = edges.filter("u = v").select(F.col("u").alias("member")).distinct()
    edges = stores.cut(edges.filter("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stores.cut(small.filter("u != v").distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())
        if now == before:
            break
        before = now
    linked = edges.select(F.col("u").alias("member"), F.col("v").alias("root"))
    roots = edges.select("v").distinct().select(F.col("v").alias("member"), F.col("v").alias("root"))
    return linked.unionByName(roots).unionByName(alone.join(linked.unionByName(roots), "member", "left_anti").withColumn("root", F.col("member")))


def backfilled(pairs: DataFrame, current: DataFrame, members: DataFrame, seen: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Families, their members, and ids that were joined into others, from pairwise findings and the members known so far.

    pairs: submission_id, matched_submission_id, family_key, method, confidence.
    current: submission_id, content_hash, of each id's current version.
    members: family_id, submission_id, matched_submission_id, content_hash, confidence, method, first_seen, last_seen.

    Both ends of a pair are members, and pairs of one family_key and known
    members of one family belong together.  A group keeps the smallest id that
    its members had; a new one is called by its smallest member, which is in no
    other.  So a second run changes nothing but ``last_seen``, and pairs that
    join two families keep the older id and retire the other.  Of a member's
    values the newest known counts, of its confidences the largest, and its
    first day stays.  Members, canonical and counts follow from the members.
    """
    links = pairs.select("submission_id", "matched_submission_id")
    keyed = pairs.groupBy("family_key").agg(F.min(F.least("submission_id", "matched_submission_id")).alias("__first"))
    by_key = pairs.join(keyed, "family_key").select("submission_id", F.col("__first").alias("matched_submission_id"))
    first = members.groupBy("family_id").agg(F.min("submission_id").alias("__first"))
    by_family = members.join(first, "family_id").select("submission_id", F.col("__first").alias("matched_submission_id"))
    found = stores.cut(components(links.unionByName(by_key).unionByName(by_family), "submission_id", "matched_submission_id"))
    named = found.join(members.select(F.col("submission_id").alias("member"), F.col("family_id").alias("old")), "member", "left")
    ids = named.groupBy("root").agg(F.coalesce(F.min("old"), F.first("root")).alias("family_id"))
    own = found.join(ids, "root").select(F.col("member").alias("submission_id"), "family_id")

    # both ends of each pair with their current content, and what is known of them, in one pass
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("submission_id"), F.col("matched_submission_id"), F.col("confidence"), F.col("method")),
        F.struct(F.col("matched_submission_id").alias("submission_id"), F.lit(None).cast(pairs.schema["matched_submission_id"].dataType).alias("matched_submission_id"), F.col("confidence"), F.col("method")),
    )).alias("e")).select("e.*")
    latest = ends.groupBy("submission_id").agg(
        F.max("matched_submission_id").alias("n_matched"), F.max("confidence").alias("n_confidence"), F.max_by("method", F.struct("confidence", "method")).alias("n_method"),
    )
    known = members.select("submission_id", *(F.col(c).alias(f"k_{c}") for c in ("matched_submission_id", "content_hash", "confidence", "method", "first_seen", "last_seen")))
    rows = own.join(latest, "submission_id", "left").join(known, "submission_id", "left").join(current.select("submission_id", F.col("content_hash").alias("n_hash")), "submission_id", "left")
    again = F.col("n_method").isNotNull()
    day = F.lit(seen).cast("date")
    rows = rows.select(
        "family_id", "submission_id", F.coalesce("n_matched", "k_matched_submission_id").alias("matched_submission_id"), F.coalesce(F.when(again, F.col("n_hash")), "k_content_hash").alias("content_hash"),
        F.greatest("n_confidence", "k_confidence").alias("confidence"), F.coalesce("n_method", "k_method").alias("method"), F.coalesce("k_first_seen", day).alias("first_seen"),
        F.when(again, day).otherwise(F.col("k_last_seen")).alias("last_seen"),
    )
    rows = stores.cut(rows)
    families = rows.groupBy("family_id").agg(
        F.min("submission_id").alias("canonical_submission_id"), F.count("*").alias("member_count"), F.max("confidence").alias("confidence"), F.max_by("method", F.struct("confidence", "method")).alias("method"),
        F.min("first_seen").alias("created_at"), F.max("last_seen").alias("last_seen"),
    )
    marked = rows.join(families.select("family_id", "canonical_submission_id"), "family_id")
    marked = marked.select(*rows.columns, (F.col("submission_id") == F.col("canonical_submission_id")).alias("is_canonical"))
    retired = named.join(ids, "root").filter("old != family_id").select(F.col("old").alias("retired_id"), "family_id").distinct()
    return families, marked, retired
