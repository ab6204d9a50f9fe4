"""A notice's opening heading that only repeats its title."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

_BLOCK = r"(?i)^\s*<(?:h[1-6]|p|div)\b"
_OPENS, _CLOSES, _VOID = r"^<[A-Za-z]", "^</[A-Za-z]", r"(?i)^<(?:br|hr|img|col|wbr)\b|/>$"


@F.pandas_udf(StringType())
def _plain(text: pd.Series) -> pd.Series:
    """Character references decoded, case folded."""
    return text.map(lambda t: html.unescape(t).casefold(), na_action="ignore")


def visible_text(text: Column) -> Column:
    """What a reader sees of a short text, for comparison: no tags, plain quotes and dashes, one space, no punctuation at the ends, case folded."""
    out = F.translate(_plain(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")), "‘’“”–— ", "''\"\"-- ")
    return F.btrim(T.squeezed(out), F.lit(" \t.:;,-–—!*"))


def _first_block(page: Column) -> Column:
    """struct(block, rest, before): the heading, paragraph or division that a page opens with; null if it opens otherwise or isn't closed."""
    parts = F.split(page, "(?=<)|(?<=>)")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(acc: Column, part: Column) -> Column:
        change = F.when(part.rlike(_CLOSES), -1).when(part.rlike(_OPENS) & ~part.rlike(_VOID), 1).otherwise(0)
        i, depth = acc["i"] + 1, acc["depth"] + change
        closed = (change < 0) & (depth == 0)
        return F.when(acc["end"] > 0, acc).otherwise(F.struct(i.alias("i"), depth.alias("depth"), F.when(closed, i).otherwise(0).alias("end")))

    cut = lambda x: F.struct(F.concat_ws("", F.slice(x["parts"], 1, x["end"])).alias("block"), F.concat_ws("", F.slice(x["parts"], x["end"] + 1, F.greatest(F.size(x["parts"]) - x["end"], F.lit(0)))).alias("rest"))
    found = F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), F.aggregate(p, start, step, lambda a: a["end"]).alias("end")))
    whole = F.transform(F.filter(found, lambda x: x["end"] > 0), cut)
    return F.when(page.rlike(_BLOCK), F.try_element_at(whole, F.lit(1)))


def without_heading(page: Column, title: Column) -> Column:
    """A sanitised page without a first block that only repeats the title; images and links in the block keep it.

    Null is an empty page; a title without visible text removes nothing.
    """
    own = F.coalesce(page, F.lit(""))
    first, wanted = _first_block(own), visible_text(title)
    inner = F.regexp_replace(first["block"], r"^\s*<[^>]*>", "")
    same = first.isNotNull() & (wanted != "") & ~inner.rlike(r"(?i)<(?:img|a)\b") & (visible_text(first["block"]) == wanted)
    return F.when(same, F.concat(F.regexp_extract(own, r"^\s*", 0), first["rest"])).otherwise(own)


def without_first_line(text: Column, title: Column) -> Column:
    """A plain text without a first line that only repeats the title, and without the empty lines after it."""
    own = F.coalesce(text, F.lit(""))
    first, wanted = F.regexp_extract(own, r"^\s*([^\n]*)", 1), visible_text(title)
    rest = F.regexp_replace(own, r"^\s*[^\n]*(?:\n(?:[^\S\n]*(?=\n))?)*", "")
    return F.when((wanted != "") & (visible_text(first) == wanted), rest).otherwise(own)
