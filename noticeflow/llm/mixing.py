"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id, source and text.  For each
source the mix takes whole passes over its documents plus those whose hash lies
under a threshold.  The threshold comes from histograms: words are summed by
source and leading hash bits, the bucket in which the budget ends is found, and
only this bucket's documents are counted again by their next bits.  Nothing is
sorted by hash, and the work runs in DataFrame functions only.

Sources may be many (a source may be a host): their shares come from running
sums over range partitions.  And one source may hold most rows: rows meet their
source's plan by salts where a source is large.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; rows with equal id, source and text get hashes of their own by
number, so that they are taken or left one by one; an empty table gives no rows;
other columns are ignored by ``mix`` and kept by ``repeated``, whatever their
names; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, scratch, staged, table

HASH_HEX, LEVEL_BITS = 15, 12
HASH_BITS = HASH_HEX * 4
WEIGHTS, CAP = (1, 2, 3), 3


def text_size(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the text, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(*parts: Column) -> Column:
    """A hash of 60 bits, alike in every run and engine that has MD5."""
    text = F.concat_ws(":", *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX), 16, 10).cast("long")


def numbered(rows: DataFrame, repeats: DataFrame, own: list[str]) -> DataFrame:
    """``rows`` with ``h``: their hash ``h0``, but for repeated rows one of their own by number.

    repeats: h0, n of the hashes of several rows.  Rows that are equal in
    ``own`` are numbered in any order, as they are interchangeable; a large group
    is numbered over parts, each from where the parts before it end.
    """
    if repeats.isEmpty():
        return rows.withColumn("h", F.col("h0"))
    hot, spread = hot_keys(repeats, ["h0"]), F.monotonically_increasing_id()
    single = salted_join(rows, repeats, ["h0"], hot, spread, "left_anti").withColumn("h", F.col("h0"))
    several = salted_join(rows, repeats, ["h0"], hot, spread, "left_semi").withColumn("pid", F.spark_partition_id())
    several = staged(several, "mix-repeated", keep=True)
    group = [*own, "pid"]
    parts = several.groupBy(*group).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*own).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    first = parts.select(*group, F.coalesce(before, F.lit(0)).alias("before"))
    i = F.row_number().over(Window.partitionBy(*group).orderBy("size")) + F.col("before")
    several = several.join(first, group).withColumn("i", i)
    h = F.when(F.col("i") == 1, F.col("h0")).otherwise(_again(*own, "i")) if own == ["h0"] else _again(*own, "i")
    return single.unionByName(several.withColumn("h", h).select(*single.columns))


def _again(*columns: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns])), 1, HASH_HEX), 16, 10).cast("long")


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the sums over all rows before each, in a global order, over range partitions."""
    w = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), name)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = placed.groupBy("part").agg(*[F.sum(c).alias(f"all_{k}") for k, c in sums.items()])
    parts = parts.select("part", *[F.coalesce(F.sum(f"all_{k}").over(upto), F.lit(0)).alias(f"first_{k}") for k in sums])
    out = placed.join(F.broadcast(parts), "part")
    return out.select(*rows.columns, *[(F.col(f"first_{k}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(k) for k, c in sums.items()])


def source_targets(per: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """key, n, source_size, target of rows (key, source, n, source_size): shares by weight, at most ``cap`` times a source's size.

    In the order of the size that a unit of weight can take, a source is full if
    an even level over it and all that follow would be above its cap.
    """
    per = _running(per, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    per = _running(per, [F.col("most") / F.col("weight"), F.col("key")], {"most_before": F.col("most"), "weight_before": F.col("weight")}, "mix-levels")
    size, all_weight = (x or 0.0 for x in per.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first())
    share = (F.lit(size) - F.col("most_before")) / (F.lit(all_weight) - F.col("weight_before"))
    per = staged(per.withColumn("full", F.col("most") <= share * F.col("weight")), "mix-full")
    full = per.agg(F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0))).first()
    level = (size - full[0]) / full[1] if full[1] else None
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.lit(level).cast("double") * F.col("weight")))
    return per.select("key", "n", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame, hot: DataFrame) -> DataFrame:
    """key, source_size, target, passes, under: take all ``passes`` times, and once more where h < under."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = staged(plan.drop("n").withColumn("prefix", F.lit(0).cast("long")).withColumn("last", F.lit(0).cast("long")), "mix-targets")
    cut, rows = Window.partitionBy("key").orderBy("bucket"), sized.select("key", "size", "h")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        if level > 1:  # only the documents of each source's boundary bucket
            rows = salted_join(rows, plan.select("key", "prefix"), ["key"], hot, F.col("h"))
            rows = staged(rows.filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")).select("key", "size", "h"), "mix-boundary")
        sums = rows.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n")).join(plan.select("key", "budget"), "key")
        upto = F.sum("n").over(cut)
        sums = sums.select("key", "bucket", "n", (F.col("budget") - (upto - F.col("n"))).alias("rest"))
        edge = sums.filter((F.col("rest") >= 0) & (F.col("rest") < F.col("n")))
        edge = edge.select("key", F.col("bucket").alias("b"), F.col("n").alias("m"), "rest")
        plan = plan.join(edge, "key", "left").select(
            "key", "source_size", "target", "passes",
            F.coalesce("rest", F.lit(0.0)).alias("budget"),
            F.coalesce("b", F.shiftleft(F.col("prefix"), LEVEL_BITS)).alias("prefix"),
            F.coalesce("m", F.lit(0)).cast("long").alias("last"),
        )
        plan = staged(plan, "mix-level")  # a row for each source
    nearer = (F.col("last") > 0) & (F.col("budget") * 2 >= F.col("last"))
    return plan.select("key", "source_size", "target", "passes", (F.col("prefix") + nearer.cast("long")).alias("under"))


def _described(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """key, source, size and hash of a row."""
    source = F.col(source_col).cast("string")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return [key.alias("key"), source.alias("source"), text_size(F.col(text_col)).alias("size"), place(F.col(id_col), source, F.col(text_col)).alias("h0")]


def _planned(sized: DataFrame, own: list[str], **limits) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows with their hashes, each source's plan, the large sources, and the hashes of several rows."""
    repeats = staged(sized.groupBy("h0").agg(F.count("*").alias("n")).filter("n > 1"), "mix-repeats", keep=True)
    rows = numbered(sized, repeats, own)
    per = staged(rows.groupBy("key", "source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "mix-sizes-of-sources", keep=True)
    hot = hot_keys(per, ["key"])
    return rows, staged(thresholds(rows, source_targets(per, **limits), hot), "mix-plan", keep=True), hot, repeats


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, times, taken for every row."""
    with scratch(docs.sparkSession):
        sized = staged(docs.select(F.col(id_col).alias("doc_id"), *_described(docs, id_col, text_col, source_col)), "mix-sizes", keep=True)
        rows, plan, hot, _ = _planned(sized, ["h0"], weights=weights, cap=cap)
    times = F.col("passes") + (F.col("h") < F.col("under")).cast("long")
    return salted_join(rows, plan, ["key"], hot, F.col("h")).select("doc_id", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    The plan has one row for a source and meets the documents under their own
    hash, so texts go through one join at most, spread over salts.  Of rows with
    equal id, source and text those that differ elsewhere have hashes of their own.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col, source_col)]
    more = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")
    described = [*_described(docs, id_col, text_col, source_col), more.alias("other")]
    with scratch(docs.sparkSession):
        sized = staged(docs.select(*described), "mix-sizes", keep=True)
        _, plan, hot, repeats = _planned(sized, ["h0", "other"], **limits)
        rows = numbered(docs.select(F.struct(*docs.columns).alias("row"), *described), repeats, ["h0", "other"])
    rows = salted_join(rows, plan.select("key", "passes", "under"), ["key"], hot, F.col("h"))
    times = F.col("passes") + (F.col("h") < F.col("under")).cast("long")
    rows = rows.select("row", times.cast("int").alias("times")).filter("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Shares with the excess levelled, then a running sum in hash order where the operator has histograms.
OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, size, CASE WHEN i = 1 THEN h0 ELSE ('0x' || substr(md5(h0::VARCHAR || ':' || i::VARCHAR), 1, 15))::BIGINT END AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY h0) AS i FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5(coalesce('v' || doc_id::VARCHAR, 'n') || ':' || coalesce('v' || source, 'n') || ':' || coalesce('v' || text, 'n')), 1, 15))::BIGINT AS h0 FROM documents))),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS weight FROM sized GROUP BY source),
lev AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS share
  FROM per WINDOW r AS (ORDER BY 3.0::DOUBLE * source_size / weight, coalesce('s' || source, 'n') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (
  SELECT source, source_size, CASE WHEN most <= share * weight THEN most ELSE least(most, weight *
      (sum(source_size) OVER () - sum(CASE WHEN most <= share * weight THEN most ELSE 0 END) OVER ())
      / nullif(sum(CASE WHEN most <= share * weight THEN 0 ELSE weight END) OVER (), 0)) END AS target FROM lev),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM tgt),
run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget, s.h,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN size > 0 AND budget > 0 AND upto - size <= budget AND (upto <= budget OR (budget - (upto - size)) * 2 >= size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
