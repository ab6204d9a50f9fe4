"""From a mention of a place to a callout: a ladder of rungs with gates for confidence and completeness, and a fallback link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as T


def callouts(mentions: DataFrame, catalogue: DataFrame, refreshed: DataFrame, links: DataFrame, least: str = "medium") -> DataFrame:
    """mention_id, outcome, method, place_id, campus, url of each mention.

    mentions: mention_id, lookup_keys (the most specific first), bare (a garage
    without a name), weak (a letter that may be prose), hint (a campus or null).
    catalogue, and refreshed (what a refresh of the sources added): alias, place_id,
    campus, confidence, latitude, longitude, description, garage.
    links: campus (null: any other), url: the official map.

    Rungs: the catalogue, then what the refresh added; in each the first key with
    a hit counts, and of its hits those on the hinted campus if there are any.  A bare
    garage is the hinted campus's only one, and asks the catalogue alone.  outcome:
    resolved; ambiguous (several places, or a bare garage on no or another number of
    garages); low_confidence; incomplete (no point or no description); unknown; ignored
    (weak and unknown).  Unresolved ones get the campus's map; ignored and ambiguous
    bare ones get none.

    Both rungs and the garages are candidates of one union, and one aggregation by
    mention decides.
    """
    place = F.struct("place_id", "campus", "confidence", "latitude", "longitude", "description").alias("place")
    keys = mentions.filter("NOT bare").select("mention_id", "hint", F.posexplode("lookup_keys").alias("pos", "alias"))
    rung = lambda df, n: keys.join(df.select("alias", place).distinct(), "alias").select("mention_id", "hint", F.lit(n).alias("rung"), "pos", "place")
    garages = catalogue.filter("garage").select(place).distinct()
    bare = mentions.filter("bare AND hint IS NOT NULL").join(garages, F.col("hint") == F.col("place.campus")).select("mention_id", "hint", F.lit(0).alias("rung"), F.lit(0).alias("pos"), "place")
    found = rung(catalogue, 0).unionByName(rung(refreshed, 1)).unionByName(bare)
    here = F.col("place.campus") == F.col("hint")
    counted = found.groupBy("mention_id", "rung", "pos").agg(
        F.countDistinct("place.place_id").alias("n"), F.countDistinct(F.when(here, F.col("place.place_id"))).alias("n_here"), F.min("place").alias("any"), F.min(F.when(here, F.col("place"))).alias("here"),
    )
    first = counted.groupBy("mention_id").agg(F.min_by(F.struct("rung", "n", "n_here", "any", "here"), F.struct("rung", "pos")).alias("x"))
    rows = mentions.join(first, "mention_id", "left")
    near = F.col("x.n_here") > 0
    several = F.when(near, F.col("x.n_here")).otherwise(F.col("x.n")) > 1
    rows = rows.withColumn("at", F.when(near, F.col("x.here")).otherwise(F.col("x.any")))
    complete = F.col("at.latitude").isNotNull() & (F.coalesce("at.description", F.lit("")) != "")
    outcome = (
        F.when(F.col("bare") & (F.col("x").isNull() | several), "ambiguous")
        .when(F.col("x").isNull() & F.coalesce("weak", F.lit(False)), "ignored")
        .when(F.col("x").isNull(), "unknown")
        .when(several, "ambiguous")
        .when(~F.col("bare") & ~T.at_least(F.col("at.confidence"), F.lit(least)), "low_confidence")
        .when(~complete, "incomplete")
        .otherwise("resolved")
    )
    rows = rows.withColumn("outcome", outcome)
    resolved, silent = F.col("outcome") == "resolved", (F.col("outcome") == "ignored") | (F.col("bare") & (F.col("outcome") == "ambiguous"))
    method = F.when(resolved, F.when(F.col("bare"), "sole_garage").when(F.col("x.rung") == 1, "refresh").otherwise("catalogue"))
    campus = F.when(resolved | F.col("outcome").isin("low_confidence", "incomplete"), F.col("at.campus")).otherwise(F.col("hint"))
    rows = rows.withColumns({"method": method, "campus": campus})
    own = links.filter("campus IS NOT NULL").select("campus", F.col("url").alias("__own"))
    other = links.filter("campus IS NULL").agg(F.min("url").alias("__other"))  # one row, whatever there is
    rows = rows.join(own, "campus", "left").join(F.broadcast(other), F.lit(True), "left")
    url = F.when(resolved, geo.maps_query(F.col("at.latitude"), F.col("at.longitude"))).when(~silent, F.coalesce("__own", "__other"))
    return rows.select("mention_id", "outcome", "method", F.when(resolved, F.col("at.place_id")).alias("place_id"), "campus", url.alias("url"))
