"""Links that a notice gives for registering, and its first heading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from . import text as T
from .markup import decoded

#: An anchor that is never closed ends before the next one, so a page is read once.
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'][^"']+["'][^>]*>.*?(?:</a\s*>|(?=<a\b)|\z)"""
_BLOCK = r"(?is)<\s*/?\s*(?:" + "|".join(S.CONTEXT_BLOCKS) + r")\b[^>]*>"


def _seen(piece: Column) -> Column:
    """Tags as spaces, references decoded, lower case without accents."""
    return T.plain_letters(F.translate(decoded(F.regexp_replace(piece, "<[^>]+>", " ")), "’‘“”", "''\"\""))


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(words)


def registration_links(df: DataFrame, page: str) -> DataFrame:
    """``df`` with one row for each link that its page gives for registering: position, href, anchor, context and reason.

    A link counts by the words of its anchor, of its address, or of the text between the start of its own block
    and the anchor (its last ``CONTEXT_CHARS`` characters, in fewer words).  Of equal addresses of a page the first
    counts; only http addresses do.  position: the anchor's place among the page's anchors, from 1.  A page is split
    at its anchors once, and one fold over the parts carries the text since the last block began; no shuffle.
    """
    anchors, between = F.col("_anchors"), F.col("_between")
    rows = df.withColumn("_anchors", F.regexp_extract_all(F.coalesce(F.col(page), F.lit("")), F.lit(ANCHOR), 0))
    rows = rows.withColumn("_between", F.split(F.coalesce(F.col(page), F.lit("")), ANCHOR, -1))

    def after(context: Column, piece: Column) -> Column:
        """The last characters of the text since a block began, with one more piece of the page."""
        own = _seen(F.regexp_replace(piece, f"(?is)^.*{_BLOCK[5:]}", ""))
        return F.right(F.concat(F.when(piece.rlike(_BLOCK), "").otherwise(context), own), F.lit(S.CONTEXT_CHARS))

    entry = "struct<before:string,found:array<struct<position:int,tag:string,context:string>>>"
    start = F.struct(F.lit("").alias("before"), F.array().alias("found")).cast(entry)

    def step(state: Column, i: Column) -> Column:
        # bound once: the context before this anchor
        contexts = F.array(after(state["before"], F.get(between, i)))
        one = lambda c: F.struct(after(c, F.get(anchors, i)).alias("before"), F.concat(state["found"], F.array(F.struct((i + 1).alias("position"), F.get(anchors, i).alias("tag"), c.alias("context")))).alias("found"))
        return F.get(F.transform(contexts, one), F.lit(0)).cast(entry)

    n = F.size(anchors)
    order = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*df.columns, F.explode(F.aggregate(order, start, step, lambda s: s["found"])).alias("_link"))
    href = F.trim(decoded(F.regexp_extract(F.col("_link.tag"), r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']""", 1)))
    inner = F.regexp_replace(F.regexp_replace(F.col("_link.tag"), r"(?is)^<a\b[^>]*>", ""), r"(?is)</a\s*>$", "")
    rows = rows.select(*df.columns, F.col("_link.position").alias("position"), href.alias("href"), T.squeezed(_seen(inner)).alias("anchor"), T.squeezed(F.col("_link.context")).alias("context"))
    reason = (
        F.when(F.col("anchor").rlike(_any_of(S.REGISTRATION_WORDS)), "anchor")
        .when(T.plain_letters(F.col("href")).rlike(_any_of(S.REGISTRATION_WORDS)), "address")
        .when(F.col("context").rlike(_any_of(S.CONTEXT_WORDS)), "context")
    )
    return rows.filter(F.lower("href").rlike("^https?://")).withColumn("reason", reason).filter(F.col("reason").isNotNull())


def first_of_each(links: DataFrame, key: str) -> DataFrame:
    """Of a page's equal addresses the first."""
    names = [c for c in links.columns if c not in (key, "href")]
    return links.groupBy(key, "href").agg(F.min_by(F.struct(*names), "position").alias("_x")).select(key, "href", *(F.col(f"_x.{c}").alias(c) for c in names))


def first_heading(page: Column, decode: Callable[[Column], Column] = decoded) -> Column:
    """The visible text of a page's first heading as it stands there; null if it has no letter or is too long.

    decode: which character references are decoded.  White space is what it is in HTML.
    """
    inner = F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<h[1-6](?![0-9a-z_])[^>]*>(.*?)</h[1-6]>", 1)
    text = F.trim(F.regexp_replace(decode(F.regexp_replace(inner, "<[^>]+>", " ")), r"[ \t\n\f\r]+", " "))
    return F.when(text.rlike(r"\p{L}") & (F.length(text) <= S.HEADING_CHARS), text)
