"""Notices posted again under a new id, and their families."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import likeness, moments
from ..functions import text as T
from ..sources import stores

_SAME = ("title_key", "category_id", "source_audience", "is_event")
_OWN = (*_SAME, "event_date", "event_start_min", "urls", "contact_email", "submitted_by_email", "body_hash", "body_chars")
#: Equal bodies have equal days, so these make no class of their own.
_FIELDS = (*_OWN, "days")
#: A unit of comparison holds so many classes and characters of bodies at most, or of two parts so many of each; one longer body is alone.
UNIT_CLASSES, UNIT_CHARS = 800, 4_000_000


def prepared(rows: DataFrame) -> DataFrame:
    """Folded title and body, distinctive words, links and named days, once for each row."""
    out = rows.withColumn("title_key", T.fold(F.col("title"))).withColumn("body_key", T.fold(F.col("body_text")))
    urls = F.transform(T.links(F.col("full_body")), lambda u: F.regexp_replace(u, "/+$", ""))
    return out.withColumns({
        "urls": F.array_sort(F.array_distinct(F.filter(urls, lambda u: F.lower(u).rlike("^https?://")))), "own_words": T.distinctive_words(F.col("body_key")),
        "days": moments.date_tokens(F.col("body_text")), "body_hash": F.md5("body_key"), "body_chars": F.length("body_key"), "is_event": F.coalesce("is_event", F.lit(False)),
    })


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class of equal compared fields and their folded body; the classes with their two smallest ids.

    What is folded and searched in the texts is kept as a table; the classes read its small columns only.
    """
    rows = prepared(rows).filter("title_key != '' AND body_key != ''").withColumn("class", F.md5(F.to_json(F.struct(*_OWN), {"ignoreNullFields": "false"})))
    rows = stores.kept(rows.select("submission_id", "class", "body_key", *_FIELDS), "repeats")
    first = rows.drop("body_key").withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("submission_id"))).filter("n <= 2")
    classes = first.groupBy("class").agg(F.array_sort(F.collect_list("submission_id")).alias("ids"), *[F.min_by(c, "n").alias(c) for c in _FIELDS])
    return rows.select("submission_id", "class", "body_key"), classes


def _units(classes: DataFrame) -> DataFrame:
    """class, unit and side: where each class is compared, so that all that can be alike meet in exactly one unit.

    Classes meet on title, category, audience, event status and an event's time.  A group of them that fits is
    one unit (side -1).  Larger ones are split by bands of length, and bands into parts: a part meets itself
    (side -1), the band's other parts and those of the next band (sides 0 and 1).  Texts of a ratio of lengths
    that a match can have lie in one band or in neighbours.
    """
    time = [F.when(F.col("is_event"), F.col(c)).alias(c) for c in ("event_date", "event_start_min")]
    band = F.floor(F.log(F.col("body_chars").cast("double")) / -F.log(F.lit(S.LENGTH_RATIO - 0.01)))
    own = classes.select("class", F.md5(F.to_json(F.struct(*_SAME, *time), {"ignoreNullFields": "false"})).alias("same"), band.alias("band"), F.col("body_chars").cast("bigint").alias("chars"))
    w = Window.partitionBy("same")
    parts = F.ceil(F.greatest(F.col("n") / UNIT_CLASSES, F.col("chars") / UNIT_CHARS))
    bands = own.groupBy("same", "band").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).select("*", parts.alias("parts"), F.sum("n").over(w).alias("all_n"), F.sum("chars").over(w).alias("all_chars"))
    at = lambda step: F.coalesce(F.when(step("band", 1).over(w.orderBy("band")) == F.col("band") + (1 if step is F.lead else -1), step("parts", 1).over(w.orderBy("band"))), F.lit(0))
    bands = bands.withColumns({"above": at(F.lead), "below": at(F.lag)}).filter("all_n > 1").drop("n", "chars")
    part = F.pmod(F.xxhash64("class"), F.col("parts"))
    unit = lambda kind, band, one, other, side: F.struct(F.concat_ws("/", "same", F.lit(kind), band.cast("string"), one.cast("string"), other.cast("string")).alias("unit"), side.cast("int").alias("side"))
    each = lambda n, f: F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>")), f)
    split = F.concat(
        each(F.col("parts"), lambda t: unit("in", F.col("band"), F.least(part, t), F.greatest(part, t), F.when(part == t, -1).when(part < t, 0).otherwise(1))),
        each(F.col("above"), lambda t: unit("up", F.col("band"), part, t, F.lit(0))),
        each(F.col("below"), lambda t: unit("up", F.col("band") - 1, t, part, F.lit(1))),
    )
    whole = (F.col("all_n") <= UNIT_CLASSES) & (F.col("all_chars") <= UNIT_CHARS)
    units = F.when(whole, F.array(F.struct(F.col("same").alias("unit"), F.lit(-1).alias("side")))).otherwise(split)
    return own.join(bands, ["same", "band"]).select("class", F.inline(units))


def _words(text: str) -> set[str]:
    """``text.distinctive_words`` of a folded text."""
    return {w for w in T.WORD.findall(text) if not w.isdigit()}.difference(S.COMMON_WORDS)


_FOUND = "class string, p_class string, similarity double, same_urls boolean, same_submitter boolean, revised boolean, respelt boolean"


def _alike(unit: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a unit with different bodies that are alike, and by what they may count; vetoes and a bound on their similarity come first."""
    unit = unit.drop_duplicates("class").sort_values(["side", "class"], ignore_index=True)
    split = None if (unit["side"] == -1).all() else int((unit["side"] == 0).sum())
    found = []
    if len(unit) > 1 and split not in (0, len(unit)):
        rows, columns = (slice(None), slice(None)) if split is None else (slice(split), slice(split, None))
        first = 0 if split is None else split
        equal = lambda c: (x := pd.factorize(unit[c], use_na_sentinel=False)[0])[rows, None] == x[None, columns]
        unknown = unit["named_days"].isna().to_numpy()
        urls, submitter = equal("link_set"), equal("submitted_by_email")
        sender = submitter & equal("contact_email")
        may = (urls | sender) & ~equal("body_hash") & (equal("named_days") | unknown[rows, None] | unknown[None, columns])
        places = [likeness.Places(t) for t in unit["body_key"]]
        words = [None] * len(unit)
        now, then = unit["is_current"].to_numpy(), unit["is_prior"].to_numpy()
        forth, back = likeness.can_match(places, S.CHANGED, S.LENGTH_RATIO, split)
        both = [(forth & may & now[rows, None] & then[None, columns], False)]
        if split is not None:  # else the other way round is a pair of its own
            both.append((back & may & then[rows, None] & now[None, columns], True))
        for pairs, turned in both:
            for i, j in zip(*map(np.ndarray.tolist, np.nonzero(pairs)), strict=True):
                one, other = (j + first, i) if turned else (i, j + first)
                if (ratio := T.likeness_of(places[one], places[other], S.CHANGED)) < S.CHANGED:
                    continue
                for k in (one, other):
                    words[k] = _words(places[k].text) if words[k] is None else words[k]
                removed = words[other] - words[one]
                revised = bool(sender[i, j]) and len(removed) <= S.MAX_REMOVED_WORDS
                if urls[i, j] or revised:
                    found.append((unit["class"][one], unit["class"][other], ratio, bool(urls[i, j]), bool(submitter[i, j]), revised, T.spelling_only(removed, words[one] - words[other])))
    return pd.DataFrame(found, columns=[c.split()[0] for c in _FOUND.split(", ")])


def find_repeats(current: DataFrame, prior: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """Each current id's best prior id with method, confidence and similarity.

    Only rows whose ``source_status`` (where there is such a column) is New are
    looked at, and only priors with a delivered day: ``delivered`` holds their
    submission_id.  Rows that agree in all compared fields are one class, so copies
    are compared once.  Classes of equal bodies meet by these; others meet in units
    of bounded size, to which each body is sent once, or once for each part that a
    large group is split into, never for each pair.  In a unit vetoes come first
    (the days that both bodies name, links, senders), then a bound on the similarity
    of all pairs at once, then the similarity itself.
    """
    same = prior is current and delivered is None and "source_status" not in current.columns
    if "source_status" in current.columns:
        current = current.filter("source_status = 'New'")
    if delivered is not None:
        prior = prior.join(delivered.select("submission_id").distinct(), "submission_id", "left_semi")
    rows, c = _classes(current)
    p_rows, p = (rows, c) if same else _classes(prior)


    names = [x for x in c.columns if x != "class"]
    c_known, p_known = c.select("class", F.struct(*names).alias("c")), p.select("class", F.struct(*names).alias("p"))
    known = c_known.withColumn("p", F.col("c")) if same else c_known.join(p_known, "class", "full")
    one = F.coalesce("c", "p")
    known = known.select("class", *[one[x].alias(x) for x in names], F.col("c").isNotNull().alias("is_current"), F.col("p").isNotNull().alias("is_prior"))
    fields = known.select(
        "class", F.get("ids", F.lit(0)).alias("submission_id"), "is_current", "is_prior", "body_hash", "submitted_by_email", "contact_email",
        F.md5(F.to_json("urls")).alias("link_set"), F.when(F.size("days") > 0, F.md5(F.to_json("days"))).alias("named_days"),
    )
    bodies = rows if same else rows.unionByName(p_rows)
    unlike = bodies.join(_units(known).join(fields, "class"), ["class", "submission_id"]).drop("submission_id").groupBy("unit").applyInPandas(_alike, _FOUND)

    p = p.select(*[F.col(x).alias(f"p_{x}") for x in p.columns])
    on = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in (*_SAME, "body_hash")]
    once = ~F.col("is_event") | (F.col("event_date").eqNullSafe(F.col("p_event_date")) & F.col("event_start_min").eqNullSafe(F.col("p_event_start_min")))
    urls, submitter, contact = F.col("urls") == F.col("p_urls"), F.col("submitted_by_email").eqNullSafe(F.col("p_submitted_by_email")), F.col("contact_email").eqNullSafe(F.col("p_contact_email"))
    alike = c.join(p, on).filter(once & (urls | (submitter & contact)))
    alike = alike.select("class", "p_class", F.lit(1.0).alias("similarity"), urls.alias("same_urls"), submitter.alias("same_submitter"), (submitter & contact).alias("revised"), F.lit(True).alias("respelt"))
    found = alike.unionByName(unlike).join(c.select("class", "ids"), "class").join(p.select("p_class", "p_ids"), "p_class")
    found = found.filter(F.size(F.filter("p_ids", lambda i: ~F.array_contains("ids", i) | (F.size("ids") > 1))) > 0)
    method = (
        F.when((F.col("similarity") >= S.IDENTICAL) & F.col("same_urls"), "identical")
        .when((F.col("similarity") >= S.NEAR_IDENTICAL) & F.col("same_urls") & F.col("same_submitter"), "near_identical")
        .when(F.col("revised"), "changed")
    )
    found = found.withColumn("method", method).filter(F.col("method").isNotNull())
    found = found.withColumn("materially_changed", (F.col("method") == "changed") | ((F.col("method") == "near_identical") & ~F.col("respelt")))
    # a row's own id is no match: the two best of a class leave one for each of its rows
    found = found.select("class", "method", "similarity", "materially_changed", F.explode("p_ids").alias("match"))
    best = Window.partitionBy("class").orderBy(F.desc("similarity"), "match")
    found = found.withColumn("n", F.row_number().over(best)).filter("n <= 2")
    out = rows.select("submission_id", "class").join(found, "class").filter("submission_id != match").groupBy("submission_id", "class").agg(F.min_by(F.struct("match", "method", "similarity", "materially_changed"), "n").alias("r"))
    table = F.create_map(*[F.lit(x) for kv in S.CONFIDENCE.items() for x in kv])
    key = F.concat_ws("|", "title_key", F.coalesce(F.col("category_id").cast("string"), F.lit("")), F.coalesce("source_audience", F.lit("")))
    out = out.join(c.select("class", key.alias("family_key")), "class")
    return out.select(
        "submission_id", F.col("r.match").alias("matched_submission_id"), "family_key", F.col("r.method").alias("method"), F.element_at(table, F.col("r.method")).alias("confidence"),
        F.col("r.similarity").alias("similarity"), F.col("r.materially_changed").alias("materially_changed"),
    )


def families(members: DataFrame, key: str, member: str) -> DataFrame:
    """Each family's canonical (smallest) member and size."""
    return members.groupBy(key).agg(F.min(member).alias("canonical"), F.countDistinct(member).alias("member_count"))


def member_index(members: DataFrame, daily: DataFrame, deliveries: DataFrame, key: str = "family_key", member: str = "submission_id") -> DataFrame:
    """Every member of every family with its first and last delivered day (null: never sent) and whether it is the canonical one."""
    sent = deliveries.filter("state = 'sent'").select("target_date").distinct()
    seen = daily.join(sent, "target_date", "left_semi").groupBy(member).agg(F.min("target_date").alias("first_delivered_date"), F.max("target_date").alias("last_delivered_date"))
    own = members.select(key, member).distinct()
    canon = own.groupBy(key).agg(F.min(member).alias("__canonical"))
    return own.join(canon, key).join(seen, member, "left").select(key, member, "first_delivered_date", "last_delivered_date", (F.col(member) == F.col("__canonical")).alias("is_canonical"))


def applied(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """The day's rows with the status shown: a New one that was sent before is Standing, and changed if materially."""
    m = matches.select("submission_id", F.lit(True).alias("__again"), F.col("materially_changed").alias("__changed"))
    again = F.coalesce("__again", F.lit(False))
    shown = F.when(again & (F.col("status") == "New"), "Standing").otherwise(F.col("status"))
    return rows.join(m, "submission_id", "left").select(*[c for c in rows.columns if c != "changed"], shown.alias("display_status"), (F.coalesce("changed", F.lit(False)) | F.coalesce("__changed", F.lit(False))).alias("changed"))
