"""Place dimensions, mention linking and nearest landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import geo
from ..functions import text as T
from .digest import contained


def unique_names(rows: DataFrame, name: str, owner: str, shortest: int) -> DataFrame:
    """Names long enough that have one owner only."""
    own = rows.filter(F.length(name) >= shortest).groupBy(name).agg(F.min(owner).alias(owner), F.max(owner).alias("__other"))
    return own.filter(F.col(owner) == F.col("__other")).drop("__other")


def resolve(mentions: DataFrame, aliases: DataFrame, hint: str = "campus_hint") -> DataFrame:
    """Each mention's place: the first lookup key with a hit, narrowed to the hinted campus; null and a reason where several remain.

    mentions: mention_id, lookup_keys, hint; aliases: alias, campus, place_id.
    """
    keys = mentions.select("mention_id", hint, F.posexplode("lookup_keys").alias("pos", "alias"))
    hits = keys.join(aliases.select("alias", "campus", "place_id").distinct(), "alias")
    first = Window.partitionBy("mention_id")
    hits = hits.withColumn("__first", F.min("pos").over(first)).filter("pos = __first")
    hits = hits.withColumn("__same", F.max((F.col("campus") == F.col(hint)).cast("int")).over(first)).filter((F.coalesce("__same", F.lit(0)) == 0) | (F.col("campus") == F.col(hint)))
    one = hits.groupBy("mention_id").agg(F.countDistinct("place_id").alias("n"), F.min("place_id").alias("place_id"))
    out = mentions.select("mention_id").join(one, "mention_id", "left")
    return out.select("mention_id", F.when(F.col("n") == 1, F.col("place_id")).alias("place_id"), F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("reason"))


def first_known(rows: DataFrame, key: str, sources: dict[str, DataFrame], answer: str = "place") -> DataFrame:
    """``rows`` with the answer of the first source that has the key, and that source's name.

    Each source has one row for a key and joins once; reference tables of a
    checked size are broadcast by the optimizer.
    """
    out = rows
    for name, source in sources.items():
        out = out.join(source.select(key, F.col(answer).alias(f"__{name}")), key, "left")
    via = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), n) for n in sources], F.lit("unresolved"))
    return out.select(*rows.columns, F.coalesce(*[F.col(f"__{n}") for n in sources]).alias(answer), via.alias("via"))


def upserted(existing: DataFrame, new: DataFrame, pinned: str = "override_fields") -> DataFrame:
    """Places after a refresh: pinned fields keep their value; ``outcome`` says what happened to each new row."""
    fields = [c for c in new.columns if c != "place_id"]
    old = existing.select("place_id", F.col(pinned).alias("__pinned"), *[F.col(c).alias(f"__{c}") for c in fields])
    both = new.withColumn("__new", F.lit(True)).join(old.withColumn("__old", F.lit(True)), "place_id", "full_outer")
    held = lambda c: F.coalesce(F.array_contains("__pinned", F.lit(c)), F.lit(False))
    pick = lambda c: F.when(F.col("__new").isNull() | held(c), F.col(f"__{c}")).otherwise(F.col(c))
    changed = F.exists(F.array(*[~F.col(f"__{c}").eqNullSafe(pick(c)) for c in fields]), lambda x: x)
    outcome = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "absent").when(changed, "updated").otherwise("unchanged")
    return both.select("place_id", *[pick(c).alias(c) for c in fields], F.coalesce("__pinned", F.array().cast("array<string>")).alias(pinned), outcome.alias("outcome"))


def nearest(places: DataFrame, landmarks: DataFrame, most: int = S.NEAREST_LANDMARKS, within: float = S.NEAREST_METRES) -> DataFrame:
    """place, landmark, rank, metres, direction: the nearest landmarks of the same campus.

    Points meet by grid cells as wide as the radius, so a place is compared
    with its surroundings only, however large a campus is.  A row of cells has
    one column scale, by which both sides are placed in it.
    """
    size = within / S.METRES_PER_DEGREE
    wide = size * (1 + 1e-9)
    column = lambda row, lon: F.floor(lon * F.cos(F.radians(row * size)) / size)
    p = places.select("campus", F.col("name").alias("place"), "lat", "lon")
    p = p.withColumn("cy", F.explode(F.sequence(F.floor((F.col("lat") - wide) / size), F.floor((F.col("lat") + wide) / size))))
    east = F.least(F.lit(360.0), wide / F.cos(F.radians("lat")))
    p = p.withColumn("cx", F.explode(F.sequence(column(F.col("cy"), F.col("lon") - east), column(F.col("cy"), F.col("lon") + east))))
    m = landmarks.select("campus", F.col("name").alias("landmark"), F.floor(F.col("lat") / size).alias("cy"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    m = m.withColumn("cx", column(F.col("cy"), F.col("lon2")))
    both = p.join(m, ["campus", "cy", "cx"]).filter("place != landmark")
    both = both.withColumn("metres", geo.distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).filter(F.col("metres") <= within)
    w = Window.partitionBy("campus", "place").orderBy("metres", "landmark")
    both = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return both.select("campus", "place", "landmark", "rank", F.round("metres", 6).alias("metres"), geo.compass(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("direction"))


def kind(name: Column, permit: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.contains("garage"), "garage").when(F.lower(F.coalesce(permit, F.lit(""))).contains("patient"), "patient").when(F.lower(F.coalesce(permit, F.lit(""))).contains("visitor"), "visitor").otherwise("surface")


def place_id(campus: Column, place_kind: Column, name: Column) -> Column:
    return F.concat_ws(":", campus, F.when(place_kind == "garage", "garage").otherwise("lot"), T.slug(name))


def permit_class(permits: Column) -> Column:
    """One permit is itself, several are Mixed, none is Unknown."""
    own = F.array_distinct(F.filter(permits, lambda p: p.isNotNull()))
    return F.when(F.size(own) == 0, "Unknown").when(F.size(own) == 1, F.try_element_at(own, F.lit(1))).otherwise("Mixed")


def campus_of(notices: DataFrame, categories: DataFrame, names: DataFrame, keywords: DataFrame, key: str, text: str, category: str, shortest: int = 6) -> DataFrame:
    """key, campus, evidence: the category's campus, else that of all buildings named, else that of all keywords; several campuses are no guess.

    categories: category, campus; names and keywords: name, campus, in any spelling.  Buildings on
    two campuses leave the choice to the keywords; keywords of two are a conflict.  The words of a
    notice meet names by an equi-join on their runs.  A notice without a key has its category only.
    """
    plain = lambda c: F.trim(T.phrase_text(F.col(c)))
    words = notices.select(key, plain(text).alias("__text")).filter("__text != ''")

    def found(known: DataFrame, least: int, as_name: str) -> DataFrame:
        needles = known.select(plain("name").alias("name"), "campus").distinct()
        hits = contained(needles, words, "name", "__text", shortest=least)
        return hits.groupBy(key).agg(F.min("campus").alias(as_name), (F.min("campus") != F.max("campus")).alias(f"{as_name}_differ"))

    by_category = categories.groupBy(F.col("category").alias(category)).agg(F.min("campus").alias("__category"))
    out = notices.select(key, category).join(by_category, category, "left")
    out = out.join(found(names, shortest, "__building"), key, "left").join(found(keywords, 1, "__keyword"), key, "left")
    rule = lambda then: (
        F.when(F.col("__category").isNotNull(), then("__category", "category"))
        .when(~F.col("__building_differ"), then("__building", "building"))
        .when(F.col("__keyword_differ"), then(None, "conflict"))
        .when(F.col("__keyword").isNotNull(), then("__keyword", "keyword"))
    )
    campus = rule(lambda c, _: F.col(c) if c else F.lit(None).cast("string"))
    return out.select(key, campus.alias("campus"), F.coalesce(rule(lambda _, why: F.lit(why)), F.lit("none")).alias("evidence"))
