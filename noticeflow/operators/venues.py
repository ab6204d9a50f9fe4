"""Where a notice takes place: a cache whose entries expire, then a ladder of name fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import text as T
from .recheck import as_known


def venue_key(venue: Column) -> Column:
    """ASCII letters and digits without accents, ``&`` spelt out, one space between words; null is empty."""
    return F.trim(F.regexp_replace(F.replace(T.plain_letters(venue), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def _without_room(part: Column) -> Column:
    """A part of a venue's name without room numbers and floors, and without the words for rooms that it ends with."""
    words = F.split(T.squeezed(part), " ")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}-]", ""))
    at = lambda i: F.when((i >= 0) & (i < F.size(words)), bare(F.get(words, i))).otherwise("")
    number = lambda w: w.rlike(r"^\p{L}?-?\p{N}+\p{L}?$")
    ordinal = lambda w: w.rlike(r"^\p{N}+(?:st|nd|rd|th)$")
    room = lambda w: w.isin(*S.NUMBERED_ROOMS)
    whole = lambda w: w.rlike(rf"^(?:{'|'.join(S.NUMBERED_ROOMS)})\p{{L}}?-?\p{{N}}+\p{{L}}?$")
    gone = lambda w, i: (room(w) & number(at(i + 1))) | (number(w) & room(at(i - 1))) | whole(w) | (ordinal(w) & (at(i + 1) == "floor")) | ((w == "floor") & ordinal(at(i - 1)))
    left = F.array_join(F.filter(words, lambda w, i: ~gone(bare(w), i)), " ")
    return F.btrim(F.regexp_replace(left, rf"(?i)(?:(?:^|\s+)[^a-z0-9\s]*(?:{'|'.join(S.ROOM_WORDS)})[^a-z0-9\s]*)+$", ""), F.lit(" .,;:-"))


def fragments(venue: Column) -> Column:
    """Names to look a venue up by, the most telling first: the whole, its parts between separators, each also without its room.

    A name without its room counts only with two words or more.  A dash separates where a space is beside it.
    """
    whole = T.squeezed(venue)
    parts = F.transform(F.split(whole, r"[,;|]|\s[-–—]|[-–—]\s"), lambda p: F.btrim(p, F.lit(" .,;:-")))
    parts = F.array_distinct(F.concat(F.array(whole), F.filter(parts, lambda p: p != "")))
    both = F.flatten(F.transform(parts, lambda p: F.filter(F.array(p, _without_room(p)), lambda x, i: (i == 0) | x.contains(" "))))
    return F.filter(F.array_distinct(both), lambda p: venue_key(p) != "")


def _runs(key: Column) -> Column:
    """All runs of a name's words that are long enough to be found inside it."""
    words = F.split(key, " ")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " "))))
    return F.array_distinct(F.filter(runs, lambda r: F.length(r) >= S.CONTAINED_CHARS))


def located(venues: DataFrame, landmarks: DataFrame, facilities: DataFrame) -> DataFrame:
    """key, hint, source, fragment, name, campus, latitude, longitude of each distinct (venue, hint) that can be told.

    venues: venue, hint (a campus or null).  landmarks, facilities: name, campus,
    latitude, longitude; a facility's name may be any of its aliases.
    Landmarks come before facilities, and of each the fragments in their order:
    a landmark of that very name, else one that holds it as whole words.  Names on
    several campuses tell nothing unless the hint's campus has just one.

    All rungs meet in one equi-join on names (a landmark's name is there with all
    runs of its words), and one aggregation decides.
    """
    asked = venues.select(venue_key(F.col("venue")).alias("key"), "venue", "hint").filter("key != ''").groupBy("key", "hint").agg(F.min("venue").alias("venue"))
    steps = asked.select("key", "hint", F.posexplode(fragments(F.col("venue"))).alias("step", "fragment")).withColumn("name_key", T.facility_name(F.col("fragment"))).filter("name_key != ''")
    place = F.struct("name", "campus", "latitude", "longitude").alias("place")
    own = T.facility_name(F.col("name"))
    marks = landmarks.select(own.alias("own_key"), place)
    names = (
        marks.select(F.col("own_key").alias("name_key"), F.lit(0).alias("rung"), "place")
        .unionByName(marks.select(F.explode(_runs(F.col("own_key"))).alias("name_key"), F.lit(1).alias("rung"), "place", "own_key").filter("name_key != own_key").drop("own_key"))
        .unionByName(facilities.select(own.alias("name_key"), F.lit(2).alias("rung"), place))
    )
    found = steps.join(names, "name_key").groupBy("key", "hint", "step", "fragment", "rung").agg(
        F.count("*").alias("n"), F.count_if(F.col("place.campus").eqNullSafe(F.col("hint")) & F.col("hint").isNotNull()).alias("n_hint"),
        F.min(F.when(F.col("place.campus") == F.col("hint"), F.col("place"))).alias("at_hint"), F.min("place").alias("first"),
        (F.countDistinct("place.campus") + F.max(F.when(F.col("place.campus").isNull(), 1).otherwise(0))).alias("campuses"),
    )
    told = F.when(F.col("n") == 1, F.col("first")).when(F.col("n_hint") == 1, F.col("at_hint")).when(F.col("campuses") == 1, F.col("first"))
    # a fragment that is a landmark's very name isn't looked for inside others, even if it tells nothing
    exact = F.when(F.col("rung") == 1, 1).otherwise(0)
    first = found.withColumn("told", told).groupBy("key", "hint", "step", "fragment", (F.col("rung") == 2).alias("facility")).agg(F.min_by("told", exact).alias("told"))
    best = first.filter("told IS NOT NULL").groupBy("key", "hint").agg(F.min_by(F.struct("facility", "fragment", "told"), F.struct("facility", "step")).alias("x"))
    source = F.when(F.col("x.facility"), "facility").otherwise("landmark")
    return best.select("key", "hint", source.alias("source"), F.col("x.fragment").alias("fragment"), F.col("x.told.*"))


def looked_up(rows: DataFrame, cache: DataFrame, landmarks: DataFrame, facilities: DataFrame, fingerprint: Column, days: int = S.VENUE_DAYS) -> DataFrame:
    """``rows`` (venue, hint, day, ...) with key, state, source, fragment, name, campus, latitude, longitude and minutes.

    cache: key, name, campus, latitude, longitude, minutes, fingerprint, verified (a date).  On each row's day
    the entry verified last counts.  state: hit (its minutes may be used), stale (too old, of another
    fingerprint, or without minutes: its place counts still), miss (no entry with a place; the ladder gives the
    place, if any), none (no venue).  Rows of a hit or stale entry never reach the ladder.
    """
    fields = ["name", "campus", "latitude", "longitude", "minutes", "fingerprint", "verified"]
    own = [c for c in rows.columns if c not in ("key", "state", "source", "fragment", *fields)]
    keyed = rows.select(*own, venue_key(F.col("venue")).alias("key"))
    known = as_known(keyed, cache.filter("key != ''"), "key", "day", "verified", fields)
    usable = F.col("known_latitude").isNotNull()
    fresh = usable & F.col("known_minutes").isNotNull() & F.col("known_fingerprint").eqNullSafe(fingerprint) & (F.col("known_verified") >= F.date_sub(F.col("day"), days))
    state = F.when(F.col("key") == "", "none").when(F.coalesce(fresh, F.lit(False)), "hit").when(usable, "stale").otherwise("miss")
    known = known.withColumn("state", state)
    cached = known.filter("state != 'miss'").select(
        *own, "key", "state", F.when(F.col("state") != "none", "cache").alias("source"), F.lit(None).cast("string").alias("fragment"), *(F.col(f"known_{c}").alias(c) for c in fields[:4]),
        F.when(F.col("state") == "hit", F.col("known_minutes")).alias("minutes"),
    )
    missed = known.filter("state = 'miss'").select(*own, "key", "state")
    found = located(missed, landmarks, facilities).select(F.col("key").alias("__key"), F.col("hint").alias("__hint"), "source", "fragment", *fields[:4])
    missed = missed.join(found, (F.col("key") == F.col("__key")) & F.col("hint").eqNullSafe(F.col("__hint")), "left")
    return cached.unionByName(missed.select(*own, "key", "state", "source", "fragment", *fields[:4], F.lit(None).cast(cached.schema["minutes"].dataType).alias("minutes")))
