"""What a day's digest, its documents and its operations need beyond the joins: grouping, checks, statistics and small state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def statistics(counts: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the size of each frame, a job for all of them."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()])


def display_groups(rows: DataFrame, day: list[str]) -> DataFrame:
    """New items under their category: groups by priority and title, items by rank and then the newest id; position within the group."""
    w = Window.partitionBy(*day, "priority", "category").orderBy("rank", F.desc("submission_id"))
    groups = rows.filter("status = 'New'").withColumn("position", F.row_number().over(w))
    first = Window.partitionBy(*day).orderBy("priority", "category")
    return groups.withColumn("group", F.dense_rank().over(first))


def standing_order(rows: DataFrame, day: list[str]) -> DataFrame:
    """Standing items as one list by rank and then the newest id."""
    w = Window.partitionBy(*day).orderBy("rank", F.desc("submission_id"))
    return rows.filter("status = 'Standing'").withColumn("position", F.row_number().over(w))


def preheader(rows: DataFrame, day: list[str], order: list[str], titles: int = 3, limit: int = 180) -> DataFrame:
    """The day's first titles in one line of bounded length."""
    w = Window.partitionBy(*day).orderBy(*order)
    first = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= titles)
    line = first.groupBy(*day).agg(F.array_sort(F.collect_list(F.struct("n", "title"))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: x["title"]), " · ")
    return line.select(*day, F.when(F.length(joined) > limit, F.concat(F.rtrim(F.substring(joined, 1, limit - 1)), F.lit("…"))).otherwise(joined).alias("preheader"))


def digest_hash(rows: DataFrame, day: str, order: str, item: str, content: str) -> DataFrame:
    """One hash of a day, the order of its items and their contents: what a reader gets on one day, so some hundred items in one row."""
    all_items = F.array_sort(F.collect_list(F.struct(order, F.col(item).cast("string").alias("i"), F.col(content).alias("c"))))
    line = F.array_join(F.transform("all", lambda x: F.concat_ws("=", x["i"], x["c"])), "|")
    return rows.groupBy(day).agg(all_items.alias("all")).select(day, F.sha2(F.concat_ws("|", F.col(day).cast("string"), line), 256).alias("digest"))


def sequential(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """key, sequential: no interval begins before an earlier one ends; a missing end is the start."""
    stop = F.coalesce(end, start)
    w = Window.partitionBy(*key).orderBy(start, stop)
    overlap = F.col(start) < F.lag(stop).over(w)
    return rows.withColumn("__over", F.coalesce(overlap, F.lit(False))).groupBy(*key).agg((~F.max("__over")).alias("sequential"))


def callouts(rows: DataFrame, notice: str, place: str, order: str, most: int = 6) -> DataFrame:
    """A notice's first mention of each place, and the first unresolved one, at most ``most``."""
    first = Window.partitionBy(notice, F.coalesce(F.col(place).cast("string"), F.lit("?"))).orderBy(order)
    once = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    w = Window.partitionBy(notice).orderBy(order)
    return once.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)


def sole(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Groups of exactly one item, with it."""
    return rows.groupBy(group).agg(F.countDistinct(item).alias("__n"), F.min(item).alias(item)).filter("__n = 1").drop("__n")


def contained(needles: DataFrame, names: DataFrame, needle: str, name: str, shortest: int = 6, longest_words: int = 8) -> DataFrame:
    """Pairs in which a needle's words stand side by side within a name: an equi-join on the names' runs of words, no nested loop.

    Needles under ``shortest`` characters meet nothing.  A needle meets by its first ``longest_words`` words, and
    what it has beyond them is compared where they met.  A name is cut only into runs of lengths that the needles have:
    these, at most ``longest_words`` numbers, are fetched first.  Words are separated by spaces.
    """
    words = lambda c: F.filter(F.split(F.col(c), " +"), lambda w: w != "")
    short = needles.filter(F.length(needle) >= shortest).withColumn("__words", words(needle)).filter(F.size("__words") > 0)
    short = short.withColumn("__n", F.least(F.size("__words"), F.lit(longest_words))).withColumn("__run", F.array_join(F.slice("__words", F.lit(1), F.col("__n")), " "))
    lengths = sorted(r[0] for r in short.select("__n").distinct().collect())  # at most longest_words numbers
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("__parts") - n + 1), lambda i: F.array_join(F.slice("__parts", i, n), " "))
    none = F.array().cast("array<string>")
    runs = F.concat(none, *[F.when(F.size("__parts") >= n, run(n)).otherwise(none) for n in lengths])
    own = names.withColumn("__parts", words(name)).withColumn("__run", F.explode(F.array_distinct(runs))).drop("__parts")
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    whole = (F.size("__words") <= longest_words) | spaced(words(name)).contains(spaced(F.col("__words")))
    return short.join(own, "__run").filter(whole).drop("__run", "__words", "__n")


def picked(hits: DataFrame, key: str, campus: str, hint: str, answer: str) -> DataFrame:
    """The one unambiguous hit of a key: the only one, the only one on the hinted campus, or any if all are on one campus."""
    same = F.col(campus) == F.col(hint)
    own = hits.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(F.when(same, 1).otherwise(0)).alias("near"), F.countDistinct(campus).alias("campuses"), F.min(answer).alias("any"), F.min(F.when(same, F.col(answer))).alias("one"),
    )
    return own.select(key, F.when(F.col("n") == 1, F.col("any")).when(F.col("near") == 1, F.col("one")).when(F.col("campuses") == 1, F.col("any")).alias(answer))


def unseen(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key the earlier run lacks."""
    return new.join(old.select(key).distinct(), key, "left_anti").select(*new.columns)


def refreshed(known: DataFrame, fetched: DataFrame, at: Column) -> DataFrame:
    """Sources after a fetch: last_changed moves with the fingerprint only; status says what happened.

    known: source_id, fingerprint, last_changed; fetched: source_id, fingerprint (null: failed), by_hand.
    """
    both = known.select("source_id", F.col("fingerprint").alias("old"), "last_changed").join(fetched, "source_id", "full_outer")
    moved = F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("old"))
    status = F.when(F.col("fingerprint").isNull(), "failed").when(~moved, "unchanged").when(F.coalesce("by_hand", F.lit(False)) & F.col("old").isNotNull(), "review").otherwise("changed")
    return both.select("source_id", F.coalesce("fingerprint", "old").alias("fingerprint"), F.when(moved, at).otherwise(F.col("last_changed")).alias("last_changed"), status.alias("status"))


def pinned(places: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Places with values set by hand and their fields pinned; an override whose ``clear`` holds unpins the place.

    overrides: place_id, clear, and the fields, null where nothing is set.
    """
    own = overrides.select("place_id", F.coalesce("clear", F.lit(False)).alias("__clear"), *[F.col(c).alias(f"__{c}") for c in fields])
    named = F.array_compact(F.array(*[F.when(F.col(f"__{c}").isNotNull(), c) for c in fields]))
    none = F.array().cast("array<string>")
    pins = F.when(F.col("__clear"), none).otherwise(F.array_union(F.coalesce("override_fields", none), F.coalesce(named, none)))
    value = lambda c: F.when(F.coalesce("__clear", F.lit(False)), F.col(c)).otherwise(F.coalesce(f"__{c}", c)).alias(c)
    out = places.join(own, "place_id", "left")
    return out.select(*[value(c) if c in fields else pins.alias(c) if c == "override_fields" else F.col(c) for c in places.columns])


def last_wins(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the new row of a key stays."""
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__side").alias("r")).select(*keys, "r.*").select(*existing.columns)


def misses(counters: DataFrame, failed: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Counters after a run: attempts and calls added for what failed, keys gone that were resolved."""
    both = counters.unionByName(failed).groupBy(key).agg(F.sum("attempts").alias("attempts"), F.sum("calls").alias("calls"))
    return both.join(resolved.select(key).distinct(), key, "left_anti")


def run_log(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs with what their end says; one without an end is still running."""
    done = ends.select("run_id", "completed_at", F.col("status").alias("__status"))
    return starts.join(done, "run_id", "left").select(*starts.columns, "completed_at", F.coalesce("__status", F.lit("running")).alias("status"))


def run_metrics(rows: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """The group's sums as a JSON text."""
    own = rows.groupBy(*group).agg(*[F.sum(c).cast("bigint").alias(k) for k, c in sums.items()])
    return own.select(*group, F.to_json(F.struct(*sums)).alias("metrics"))


def snapshot(runs: DataFrame, group: list[str], order: str, most: int = 10, chars: int = 300) -> DataFrame:
    """The newest runs of each group with their texts scrubbed and clipped."""
    w = Window.partitionBy(*group).orderBy(F.desc(order))
    return runs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).withColumn("error", T.redact(F.col("error"), chars))


def priority_map(spark: SparkSession, titles: list[str]) -> DataFrame:
    """title, priority: a list's order as a table; small by nature."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(titles, 1)], "title string, priority int")


def data_uris(page: Column) -> Column:
    """The bytes of a page's base64 images, in order."""
    found = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?i)data:image/[a-z+.]+;base64,([A-Za-z0-9+/=\s]+)"), 1)
    return F.transform(found, lambda x: F.try_to_binary(F.regexp_replace(x, r"\s+", ""), F.lit("base64")))


def budget(rows: DataFrame, group: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Rows with a flag: the running sum of the group's sizes stays within the limit."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("fits", F.sum(size).over(w) <= limit)


def health(components: DataFrame, group: list[str]) -> DataFrame:
    """group, overall, problems: the worst state of the components, and those that aren't ok with their details in order.

    components: name, state (ok, unknown, degraded, failed; null is unknown), detail.
    """
    rank = F.array_position(F.array(*map(F.lit, ("ok", "unknown", "degraded", "failed"))), F.coalesce("state", F.lit("unknown")))
    worst = F.max_by(F.coalesce("state", F.lit("unknown")), rank)
    bad = F.when(F.coalesce("state", F.lit("unknown")) != "ok", F.concat_ws(": ", "name", F.coalesce("detail", F.lit("no detail"))))
    own = components.groupBy(*group).agg(worst.alias("overall"), F.array_sort(F.collect_list(bad)).alias("problems"))
    return own.select(*group, "overall", F.array_join("problems", "; ").alias("problems"))
