"""Deterministic scores and ranks of a day's items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import text as T


def status(dates: Column, target: Column) -> Column:
    """New on the first distribution date, Standing after."""
    return F.when(F.array_min(dates) == target, "New").otherwise("Standing")


def priority(manual: Column, inferred: Column) -> Column:
    return F.coalesce(manual, inferred, F.lit(S.UNKNOWN_PRIORITY))


def proximity(event_date: Column, target: Column) -> Column:
    days = F.datediff(event_date, target)
    return F.when(days.isNull() | (days < 0), 0).otherwise(F.greatest(F.lit(0), 30 - days))


def rank_new(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rank in each group by extra edition, change, nearness of the event, newest id."""
    w = Window.partitionBy(*group).orderBy(F.desc("extra_edition"), F.desc("changed"), F.desc("proximity"), F.desc("submission_id"))
    return rows.withColumn("rank", F.row_number().over(w))


def standing_score() -> Column:
    """Of columns priority, days_old, changed, proximity, audience, prior_appearances, extra_edition."""
    return (
        F.greatest(F.lit(0.0), 120.0 - F.col("priority") * 3.0)
        + F.greatest(F.lit(0.0), 20.0 - F.coalesce("days_old", F.lit(0)))
        + F.when(F.col("changed"), 25.0).otherwise(0.0)
        + F.col("proximity")
        + F.when(F.col("audience") == "Both", 6.0).otherwise(0.0)
        - 2.0 * F.coalesce("prior_appearances", F.lit(0))
        + F.when(F.col("extra_edition"), 200.0).otherwise(0.0)
    )


def rank_standing(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rank of a day's items by score, newest id first among equals; ``group`` names the day."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("submission_id"))
    return rows.withColumn("score", F.round(standing_score(), 2)).withColumn("rank", F.row_number().over(w))


def best_candidate(pairs: DataFrame, key: str, score: str, match: str) -> DataFrame:
    """Each key's candidate of the highest score, the smallest id among equals."""
    rest = [c for c in pairs.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(match)))
    return pairs.groupBy(key).agg(best.alias("r")).select(key, "r.*").select(*pairs.columns)


def _phrases(text: Column, signals: dict[str, float]) -> Column:
    """The signals' phrases that stand in a folded text, each once, found in one walk over its words.

    A look ahead from each space, so that phrases may overlap; the longer ones
    come first, and what a found one begins with is found, too.
    """
    by_letter: dict[str, list[str]] = {}
    for p in sorted(signals, key=len, reverse=True):
        by_letter.setdefault(p[0], []).append(p[1:])
    anywhere = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))
    found = F.regexp_extract_all(text, F.lit(f"(?= ({anywhere}) )"), F.lit(1))
    begun = {p: [q for q in signals if p.startswith(f"{q} ")] for p in signals}
    begun = {p: qs for p, qs in begun.items() if qs}
    if begun:
        more = F.create_map(*(x for p, qs in begun.items() for x in (F.lit(p), F.array(*map(F.lit, qs)))))
        found = F.concat(found, F.flatten(F.transform(found, lambda p: F.coalesce(F.try_element_at(more, p), F.array().cast("array<string>")))))
    return F.array_distinct(found)


def _sum(found: Column, signals: dict[str, float], scale: float = 1.0) -> Column:
    return sum((F.when(F.array_contains(found, p), w * scale).otherwise(0.0) for p, w in signals.items()), F.lit(0.0))


def _graded(identity: Column, purpose: Column, signals: dict[str, float]) -> Column:
    """Each phrase once, at the weight of the strongest place in which it stands."""
    return sum((F.when(F.array_contains(identity, p), w).when(F.array_contains(purpose, p), w * S.PURPOSE_WEIGHT).otherwise(0.0) for p, w in signals.items()), F.lit(0.0))


def with_relevance(rows: DataFrame, title: Column, body: Column, audience: Column, category: Column, name: str = "score") -> DataFrame:
    """``rows`` with a score from 0 to 1 of capped parts; phrases below the opening can move it a little only.

    The three texts are folded and searched once, for all phrases together.
    """
    body = F.coalesce(body, F.lit(""))
    signals = {**S.IDENTITY_SIGNALS, **S.TOPIC_SIGNALS, **S.ROUTINE_SIGNALS, **S.BREADTH_SIGNALS}
    texts = {"__identity": T.phrase_text(title), "__purpose": T.phrase_text(F.substring(body, 1, S.PURPOSE_CHARS)), "__rest": T.phrase_text(F.substring(body, S.PURPOSE_CHARS + 1, 2**31 - 1))}
    texts = {name: _phrases(text, signals) for name, text in texts.items()}
    identity, purpose, rest = map(F.col, texts)
    lookup = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(0.0))
    topic = _sum(identity, S.IDENTITY_SIGNALS) + _graded(identity, purpose, S.TOPIC_SIGNALS)
    rows = rows.withColumns({**texts, "__audience": audience, "__category": lookup(S.CATEGORY_WEIGHTS, category)})
    rows = rows.withColumns({"__topic": topic, "__routine": _graded(identity, purpose, S.ROUTINE_SIGNALS), "__detail": _sum(rest, S.TOPIC_SIGNALS, S.BODY_WEIGHT) - _sum(rest, S.ROUTINE_SIGNALS, S.BODY_WEIGHT)})
    both = (F.col("__audience") == "Both") & (F.col("__routine") == 0)
    breadth = lookup(S.AUDIENCE_WEIGHTS, F.col("__audience")) + F.when(both, S.BROAD_BONUS).otherwise(0.0) + _graded(identity, purpose, S.BREADTH_SIGNALS)
    score = (
        S.RELEVANCE_BASE + F.least("__topic", F.lit(S.TOPIC_CAP)) + F.greatest(-F.col("__routine"), F.lit(S.ROUTINE_CAP)) + F.least(breadth, F.lit(S.BREADTH_CAP))
        + F.col("__category") + F.greatest(F.lit(-S.BODY_CAP), F.least(F.lit(S.BODY_CAP), F.col("__detail")))
    )
    out = rows.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    return out.drop(*texts, "__audience", "__category", "__topic", "__routine", "__detail")


def offered(rows: DataFrame, group: list[str], order: list[str], threshold: float = S.RELEVANCE_THRESHOLD, most: int = S.MAX_ACTIONS) -> DataFrame:
    """The first ``most`` rows of each group that reach the threshold and could be built."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.filter((F.col("score") >= threshold) & F.col("built")).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)
