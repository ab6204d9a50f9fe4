"""Map layers as XML: folders of placemarks become places and landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as T
from ..operators import places as P

_POINT = "struct<coordinates: string>"
_RING = "struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
_PLACEMARK = f"struct<name: string, description: string, Point: {_POINT}, Polygon: {_RING}, MultiGeometry: struct<Polygon: array<{_RING}>>>"
SCHEMA = f"name string, Placemark array<{_PLACEMARK}>"


def coordinates(text: Column) -> Column:
    """array of struct(lat, lon) from 'lon,lat[,alt] ...'; parts that are no numbers go."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "), lambda t: t.contains(","))
    points = F.transform(parts, lambda t: F.struct(F.split(t, ",")[1].try_cast("double").alias("lat"), F.split(t, ",")[0].try_cast("double").alias("lon")))
    return F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def opened(ring: Column) -> Column:
    """A ring without its closing point."""
    closed = (F.size(ring) > 1) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """file, folder, label, description, lat, lon: placemarks with a usable position."""
    rows = spark.read.schema(SCHEMA).option("rowTag", "Folder").xml(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " ")).alias("folder"), F.posexplode("Placemark").alias("pos", "m"))
    outer = lambda p: coordinates(p["outerBoundaryIs"]["LinearRing"]["coordinates"])
    rings = F.concat(F.array(coordinates(F.col("m.Point.coordinates")), outer(F.col("m.Polygon"))), F.transform(F.coalesce("m.MultiGeometry.Polygon", F.array().cast(f"array<{_RING}>")), outer))
    longest = F.aggregate(rings, F.array().cast("array<struct<lat:double,lon:double>>"), lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))
    rows = geo.worked_out(geo.worked_out(rows, longest, "longest"), opened(F.col("longest")), "ring").filter("size(ring) > 0")
    rows = geo.with_interior_point(rows, "ring", "at").filter("at.lat BETWEEN -90 AND 90 AND at.lon BETWEEN -180 AND 180")
    return rows.select("file", "folder", "pos", F.trim(F.regexp_replace(F.coalesce("m.name", F.lit("")), r"\s+", " ")).alias("label"), F.coalesce("m.description", F.lit("")).alias("description"), "at.lat", "at.lon")


def parking(marks: DataFrame, campus: Column, permits: dict[str, str]) -> DataFrame:
    """One row for each named place: id, kind, permit class over all of its placemarks, first position.

    ``permits``: lower-case label or folder to use class.  A name given as
    'Name: ...' in the description goes before the placemark's own.
    """
    rows = marks.filter(F.lower("folder").contains("parking")).withColumn("campus", campus)
    inner = F.trim(F.regexp_extract("description", r"(?i)(?:^|<br>|\n)\s*name:\s*([^<\n]+)", 1))
    name = F.coalesce(F.nullif(inner, F.lit("")), F.col("label"))
    table = F.create_map(*[F.lit(x) for kv in permits.items() for x in kv]) if permits else F.create_map().cast("map<string,string>")
    permit = F.coalesce(F.try_element_at(table, F.lower("label")), F.try_element_at(table, F.lower("folder")))
    rows = rows.withColumn("name", name).withColumn("permit", permit)
    rows = rows.filter((F.col("name") != "") & (F.lower("name") != F.lower("folder")) & ((F.col("name") != F.col("label")) | F.try_element_at(table, F.lower("label")).isNull()))
    out = rows.groupBy("campus", "name").agg(F.collect_set("permit").alias("permits"), F.min_by(F.struct("lat", "lon"), F.struct("file", "folder", "pos")).alias("at"))
    out = out.withColumn("permit_class", P.permit_class(F.col("permits"))).withColumn("kind", P.kind(F.col("name"), F.col("permit_class")))
    return out.select(P.place_id(F.col("campus"), F.col("kind"), F.col("name")).alias("place_id"), "campus", "name", "kind", "permit_class", "at.lat", "at.lon")


def landmarks(marks: DataFrame, campus: Column) -> DataFrame:
    """Named placemarks of the other folders, once for each name and place (five decimals)."""
    rows = marks.filter(~F.lower("folder").contains("parking") & (F.col("label") != "")).withColumn("campus", campus).withColumn("name_key", T.facility_name(F.col("label")))
    near = [F.round("lat", 5).alias("lat5"), F.round("lon", 5).alias("lon5")]
    first = rows.groupBy("campus", "name_key", *near).agg(F.min_by(F.struct(F.col("label").alias("name"), F.col("folder").alias("category"), "lat", "lon"), F.struct("file", "folder", "pos")).alias("m"))
    return first.select("campus", "name_key", "m.*")
