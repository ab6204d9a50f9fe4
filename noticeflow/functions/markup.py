"""Sanitised pages: an allow-list of elements, attributes, styles and addresses, and what a digest makes of them.

A page's tokens are an array, each tag's attributes and styles are expressions
over it, and only the nesting is walked in Python (``nesting``).  All stays in
its row: nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from . import text as T
from .nesting import nested

#: Loops are possessive, so that Java neither recurses nor steps back on long values.
_TAG = r"""</?[a-z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
_RAW = "(?:" + "|".join(S.RAW_TAGS) + ")"
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*+>|\z)|<[!?][^>]*+(?:>|\z)|{_TAG}|[^<]++|<"
_ATTRIBUTE = r"""(?s)[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++))?"""
_REFERENCE = r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
_BLANK = r"(?:\s| |&nbsp;|&#160;|&#[xX][aA]0;)"
_ACTIVE = r"(?i)url\s*\(|expression\s*\(|javascript:|vbscript:|@import|behaviou?r|-moz-binding|\\|&#|<|>"


@dataclass(frozen=True)
class Look:
    """What a digest imposes on kept text: colours, alignment and margins; None leaves the author's."""

    body: str | None = "#1a1a1a"
    heading: str | None = "#57150B"
    link: str | None = "#57150B"
    align: str | None = "left"
    centred_chars: int = 200
    margins: bool = True


PLAIN = Look(None, None, None, None, margins=False)


def _escaped(text: Column, quotes: bool = False) -> Column:
    out = F.regexp_replace(text, r"&(?!(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")
    out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def decoded(text: Column) -> Column:
    """The references decoded that a page can't do without: quotes, angle brackets, the fixed space and the ampersand, which comes last."""
    for pattern, char in ((r"&quot;|&#34;", '"'), (r"&apos;|&#39;", "'"), (r"&lt;", "<"), (r"&gt;", ">"), (r"&nbsp;|&#160;", " "), ("&amp;", "&")):
        text = F.regexp_replace(text, pattern, char)
    return text


def markup_decoded(text: Column) -> Column:
    """The references decoded without which a text would be markup; others stay as they stand."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _value(attribute: Column) -> Column:
    """An attribute's value without quotes, decoded; null if it has none."""
    raw = F.regexp_extract(attribute, r"(?s)^[^=]*+=\s*+(.*)$", 1)
    bare = F.when(raw.rlike("""(?s)^(?:".*"|'.*')$"""), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(attribute.contains("="), decoded(bare))


def _attributes(tag: Column) -> Column:
    """array<struct<name, value>> of a start tag; of one name the first."""
    inner = F.regexp_replace(tag, r"(?s)^<[^\s/>]++|/?>$", "")
    found = F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), 0)
    return F.transform(found, lambda a: F.struct(F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"), _value(a).alias("value")))


def _one(attributes: Column, name: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))["value"]


def _declarations(style: Column) -> Column:
    """array<struct<name, value>> of the allowed and inert declarations, of one name the last."""
    parts = F.transform(
        F.split(F.coalesce(style, F.lit("")), ";"),
        lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("name"), F.trim(F.regexp_extract(d, r"(?s)^[^:]*:(.*)$", 1)).alias("value")),
    )
    return F.filter(parts, lambda d: d["name"].isin(*S.ALLOWED_STYLES) & (d["value"] != "") & ~d["value"].rlike(_ACTIVE))


def _last_of_each(declarations: Column) -> Column:
    later = lambda d, i: ~F.exists(F.slice(declarations, i + 2, F.greatest(F.size(declarations) - i - 1, F.lit(0))), lambda x: x["name"] == d["name"])
    return F.filter(declarations, later)


def _fixed(text: str) -> Column:
    pairs = [x.partition(":") for x in text.split(";")] if text else []
    return F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("value")) for a, _, b in pairs)).cast("array<struct<name:string,value:string>>")


def _by_name(name: Column, values: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    return out.otherwise(otherwise) if out is not None else otherwise


def _placed(tag: Column) -> Column:
    """Whether a tag's own alignment goes: always on prose; elsewhere outside tables and figures if it justifies or moves text right."""
    return tag["name"].isin(*S.PROSE_TAGS) | (~tag["name"].isin(*S.STRUCTURE_TAGS) & F.coalesce(tag["declared"], F.lit("")).isin("justify", "right"))


def _kept_styles(tag: Column, look: Look) -> Column:
    """The declarations that the colour and the alignment policy leave."""
    out = tag["styles"]
    if look.body is not None:
        out = F.filter(out, lambda d: ~d["name"].isin("color", "background-color"))
    return F.filter(out, lambda d: ~(_placed(tag) & (d["name"] == "text-align"))) if look.align is not None else out


def _all_styles(tag: Column, look: Look) -> Column:
    """Default margins where the author set none, what is kept, and the imposed colour."""
    name, parts = tag["name"], [tag["own"]]
    if look.margins:
        none = F.when(~F.exists(tag["own"], lambda d: d["name"].startswith("margin")), name)
        parts.insert(0, _by_name(none, {k: _fixed(v) for k, v in S.DEFAULT_MARGINS.items()}, _fixed("")))
    if look.body is not None:
        ink = F.when(name.isin(*S.HEADING_TAGS), look.heading).when((name == "a") & tag["link"].isNotNull(), look.link).when(name.isin(*S.INKED_TAGS), look.body)
        parts.append(F.filter(F.array(F.struct(F.lit("color").alias("name"), ink.alias("value"))), lambda d: d["value"].isNotNull()))
    return F.concat(*parts)


def _other_attributes(tag: Column, look: Look) -> Column:
    """The allowed attributes but for style, each once; a link's target comes first."""
    name = tag["name"]
    allowed = _by_name(name, {k: F.array(*map(F.lit, (*v, "align", "dir", "lang"))) for k, v in S.ALLOWED_ATTRIBUTES.items()}, F.array(*map(F.lit, ("align", "dir", "lang"))))
    plain = F.filter(tag["attributes"], lambda a: F.array_contains(allowed, a["name"]) & a["value"].isNotNull() & ~((name == "a") & tag["link"].isNull()))
    if look.align is not None:
        plain = F.filter(plain, lambda a: ~(_placed(tag) & (a["name"] == "align") & (name.isin(*S.PROSE_TAGS) | F.lower(F.trim(a["value"])).isin("justify", "right"))))
    target = F.when((name == "a") & tag["link"].isNotNull(), F.concat(F.lit(' href="'), _escaped(tag["link"], True), F.lit('" target="_blank" rel="noopener noreferrer"'))).otherwise("")
    return F.concat(target, F.array_join(F.transform(plain, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), _escaped(a["value"], True), F.lit('"'))), ""))


def _faces(tags: Column, look: Look, host: str) -> Column:
    """Each start tag (name, attributes) with its link, its declared alignment, and its text up to the end of the style.

    One step after the other over the array, so that each value is worked out once.
    """
    step = lambda name, f: F.transform(out, lambda t: F.when(t.isNotNull(), t.withField(name, f(t))))  # noqa: B023, E731
    out = F.transform(tags, lambda t: F.when(t["attributes"].isNotNull(), t))
    earlier = lambda t, a, i: F.exists(F.slice(t["attributes"], F.lit(1), i), lambda x: x["name"] == a["name"])
    out = step("attributes", lambda t: F.filter(t["attributes"], lambda a, i: ~earlier(t, a, i)))
    out = step("style", lambda t: _one(t["attributes"], "style"))
    out = step("raw", lambda t: F.when(t["name"] == "a", _one(t["attributes"], "href")))
    out = step("styles", lambda t: _declarations(t["style"]))
    out = step("link", lambda t: T.repaired_link(t["raw"], host))
    out = step("align", lambda t: F.get(F.reverse(F.filter(t["styles"], lambda d: d["name"] == "text-align")), F.lit(0))["value"])
    out = step("declared", lambda t: F.coalesce(F.nullif(F.lower(t["align"]), F.lit("")), F.nullif(F.lower(F.trim(_one(t["attributes"], "align"))), F.lit(""))))
    out = step("own", lambda t: _kept_styles(t, look))
    out = step("own", lambda t: _all_styles(t, look))
    out = step("own", lambda t: _last_of_each(t["own"]))
    out = step("style", lambda t: _escaped(F.array_join(F.transform(t["own"], lambda d: F.concat(d["name"], F.lit(":"), d["value"])), ";"), True))
    out = step("shown", lambda t: F.when((t["name"] == "a") & t["link"].isNull(), "span").otherwise(t["name"]))
    out = step("start", lambda t: F.concat(F.lit("<"), t["shown"], _other_attributes(t, look)))
    return F.transform(out, lambda t: F.when(t.isNotNull(), F.struct(*(t[c].alias(c) for c in ("name", "raw", "link", "declared", "shown", "start", "style")))))


def _codes(tokens: Column) -> Column:
    """Each token as the walk's code: see ``nesting.nested``."""
    name = lambda t: F.lower(F.regexp_extract(t, r"(?i)^</?([a-z][a-z0-9:_-]*)", 1))
    # what is written <p/> means <p>; only elements that go with their content close themselves
    kind = lambda t: F.when(t.startswith("</"), "-").when(t.endswith("/>") & name(t).isin(*S.REMOVED_TAGS), "/").otherwise("+")
    return F.transform(tokens, lambda t: F.when(t.rlike(rf"(?is)^(?:<!|<\?|<{_RAW}\b)"), "!").when(t.rlike("(?is)^</?[a-z].*>$"), F.concat(kind(t), name(t))).otherwise("."))


def sanitised(df: DataFrame, page: str, out: str = "sanitised", look: Look = Look(), host: str = "https://example.org") -> DataFrame:
    """``df`` with the safe form of a page and counts of what it lost: n_links, n_links_repaired, n_links_lost, n_images.

    Elements off the allow-list go and leave what they hold, or go with it (scripts, forms, drawings); elements
    are balanced; of attributes and declarations only allowed, inert ones stay; links get a usable address or
    become plain text; images go and are counted.  Paragraphs and divisions with nothing in them go.  ``look``
    then repaints prose, aligns it (a centred block stays so while it is short, tables and figures keep theirs)
    and gives blocks margins.  Sanitising twice changes nothing more.  Null is an empty page.
    """
    tokens, codes, tags, kept = (F.col(c) for c in ("_tokens", "_codes", "_tags", "_kept"))
    rows = df.withColumn("_tokens", F.regexp_extract_all(F.coalesce(F.col(page), F.lit("")), F.lit(TOKEN), 0))
    rows = rows.withColumn("_codes", _codes(tokens))
    plain = F.transform(tokens, lambda t, i: F.struct(F.substring(F.get(codes, i), 2, 99).alias("name"), F.when(F.get(codes, i).startswith("+"), _attributes(t)).alias("attributes")))
    rows = rows.withColumn("_tags", _faces(plain, look, host))

    texts = lambda f: F.transform(tokens, lambda t, i: F.when(F.get(codes, i) == ".", f(t)).otherwise(0))
    pieces = lambda t: F.split(F.regexp_replace(t, r"&(?!amp;|lt;|gt;|nbsp;)(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", "x"), "&(?:amp|lt|gt|nbsp);")
    letters = lambda t: F.aggregate(pieces(t), F.lit(0), lambda n, p: n + F.length(T.squeezed(p)))
    edges = lambda t: F.when(t.rlike(r"^\s"), 1).otherwise(0) + F.when(t.rlike(r"\s$"), 2).otherwise(0) + F.when(t.rlike(f"^{_BLANK}*+$"), 4).otherwise(0)
    marks = F.transform(tags, lambda t: t["declared"].isNotNull())
    rows = rows.withColumn("_kept", nested(codes, texts(letters), texts(edges), marks))

    def shown(k: Column) -> Column:
        tag, setter = F.get(tags, k["at"]), k["setter"]
        centred = F.coalesce((F.get(tags, F.get(kept["at"], setter))["declared"] == "center") & (F.get(kept["size"], setter) <= look.centred_chars), F.lit(False)) & (setter >= 0)
        placed = F.concat(F.when(tag["style"] != "", ";").otherwise(""), F.lit("text-align:"), F.when(centred, "center").otherwise(look.align or ""))
        style = F.concat(tag["style"], F.when(tag["name"].isin(*S.PROSE_TAGS), placed).otherwise("")) if look.align is not None else tag["style"]
        started = F.concat(tag["start"], F.when(style != "", F.concat(F.lit(' style="'), style, F.lit('"'))).otherwise(""), F.lit(">"))
        return F.when(F.get(codes, k["at"]) == ".", _escaped(F.get(tokens, k["at"]))).when(tag["name"] == "img", "").when(k["close"], F.concat(F.lit("</"), tag["shown"], F.lit(">"))).otherwise(started)

    entries = F.arrays_zip(kept["at"].alias("at"), kept["close"].alias("close"), kept["setter"].alias("setter"))
    opened = F.transform(F.filter(entries, lambda k: ~k["close"]), lambda k: F.get(tags, k["at"]))
    count = lambda f: F.size(F.filter(opened, lambda t: F.coalesce(f(t), F.lit(False))))
    found = F.struct(
        F.array_join(F.transform(entries, shown), "").alias(out),
        count(lambda t: t["link"].isNotNull()).alias("n_links"),
        count(lambda t: t["link"] != t["raw"]).alias("n_links_repaired"),
        count(lambda t: (t["name"] == "a") & t["link"].isNull()).alias("n_links_lost"),
        count(lambda t: t["name"] == "img").alias("n_images"),
    )
    # a generator of one row: filters on the result stay above it and don't repeat these expressions
    return rows.select(*(c for c in df.columns if c not in (out, "n_links", "n_links_repaired", "n_links_lost", "n_images")), F.inline(F.array(found)))


def faults(page: Column) -> Column:
    """struct(tags, attributes, addresses, unbalanced): what a sanitised page must not hold, counted; all are 0."""
    found = F.regexp_extract_all(page, F.lit(f"(?is){_TAG}"), 0)
    name = lambda t: F.lower(F.regexp_extract(t, r"(?i)^</?([a-z][a-z0-9:_-]*)", 1))
    count = lambda f: F.size(F.filter(found, f))
    names = F.array_distinct(F.transform(found, name))
    open_ended = F.filter(names, lambda n: ~n.isin(*S.VOID_TAGS))
    gap = lambda n: F.abs(count(lambda t: (name(t) == n) & ~t.startswith("</")) - count(lambda t: (name(t) == n) & t.startswith("</")))
    return F.struct(
        count(lambda t: ~name(t).isin(*S.ALLOWED_TAGS)).alias("tags"),
        count(lambda t: t.rlike(r"(?i)\s(?:on[a-z]+|src|srcset|class|id|name)\s*=")).alias("attributes"),
        count(lambda t: t.rlike(r"""(?i)(?:href\s*=\s*["']?\s*(?!https?:|mailto:|tel:)[a-z])|javascript:|expression\s*\(|url\s*\(""")).alias("addresses"),
        F.aggregate(open_ended, F.lit(0), lambda n, x: n + gap(x)).alias("unbalanced"),
    )


def faults(page: Column) -> Column:
    """struct(tags, attributes, addresses, unbalanced): what a sanitised page must not hold, counted; all are 0."""
    found = F.regexp_extract_all(page, F.lit(f"(?is){_TAG}"), 0)
    name = lambda t: F.lower(F.regexp_extract(t, r"(?i)^</?([a-z][a-z0-9:_-]*)", 1))
    count = lambda f: F.size(F.filter(found, f))
    open_ended = F.filter(F.array_distinct(F.transform(found, name)), lambda n: ~n.isin(*S.VOID_TAGS))
    gap = lambda n: F.abs(count(lambda t: (name(t) == n) & ~t.startswith("</")) - count(lambda t: (name(t) == n) & t.startswith("</")))
    return F.struct(
        count(lambda t: ~name(t).isin(*S.ALLOWED_TAGS)).alias("tags"),
        count(lambda t: t.rlike(r"(?i)\s(?:on[a-z]+|src|srcset|class|id|name)\s*=")).alias("attributes"),
        count(lambda t: t.rlike(r"""(?i)(?:href\s*=\s*["']?\s*(?!https?:|mailto:|tel:)[a-z])|javascript:|expression\s*\(|url\s*\(""")).alias("addresses"),
        F.aggregate(open_ended, F.lit(0), lambda n, x: n + gap(x)).alias("unbalanced"),
    )
