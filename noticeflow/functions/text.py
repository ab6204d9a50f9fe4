"""Text functions: built-in expressions where there are any, pandas functions over Arrow batches for the rest."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import settings as S
from .likeness import LONG, Places, matched_length

# ---- built-in expressions ----


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def date_or_null(text: Column) -> Column:
    """A date from a strict ISO prefix; sentinels and anything else are null."""
    day = F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{4}-\d{2}-\d{2})(?:$|T)", 1)
    return F.when(text.isin(*S.DATE_SENTINELS) | (day == "1900-01-01") | (day == ""), F.lit(None)).otherwise(F.try_to_date(day, "yyyy-MM-dd"))


def minutes_or_null(text: Column) -> Column:
    """Minutes after midnight of HH:mm[:ss]; midnight means that no time is given."""
    h, m = F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{1,2}):(\d{2})", 1), F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{1,2}):(\d{2})", 2)
    total = F.when(h != "", h.cast("int") * 60 + m.cast("int"))
    return F.when((total > 0) & (total < 1440) & (m.try_cast("int") < 60), total)


def phrase_text(text: Column) -> Column:
    """ASCII letters and digits in lower case, one space between and around."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


WORD = re.compile("[a-z0-9]{4,}")


def distinctive_words(text: Column) -> Column:
    """Distinct words of four letters or more that are neither numbers nor common, sorted."""
    found = F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD.pattern), 0))
    return F.array_sort(F.filter(F.array_except(found, F.array(*map(F.lit, S.COMMON_WORDS))), lambda w: ~w.rlike("^[0-9]+$")))


def redact(text: Column, limit: int = S.SAFE_TEXT_CHARS) -> Column:
    """Without user information in addresses, bearer tokens, secret assignments and e-mail addresses, at most ``limit`` characters; the order matters."""
    out = F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))
    out = F.regexp_replace(out, S.USER_INFO, "$1[redacted]@")
    out = F.regexp_replace(out, r"(?i)\bauthorization\s*[:=]\s*bearer\s+[^\s,;]+", "Authorization: Bearer [redacted]")
    out = F.regexp_replace(out, r"(?i)\bbearer\s+(?!\[redacted\])[^\s,;]+", "Bearer [redacted]")
    out = F.regexp_replace(F.regexp_replace(out, S.ASSIGNMENT, "[redacted]"), S.EMAIL, "[redacted-email]")
    return F.nullif(F.substring(out, 1, limit), F.lit(""))


def without_emails(text: Column, shown: str = "[email removed]") -> Column:
    return F.regexp_replace(text, S.EMAIL, shown)


#: Letters with an accent and the letters without, from the characters' decompositions.
_ACCENTED = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and all(map(unicodedata.combining, d[1:]))}


def plain_letters(text: Column) -> Column:
    """In lower case without accents: of Latin letters, and marks of their own of any script."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{M}+", "")
    return F.lower(F.translate(out, "".join(_ACCENTED), "".join(_ACCENTED.values())))


def fold(text: Column) -> Column:
    """Without accents and punctuation, in lower case, one space between words."""
    return F.trim(F.regexp_replace(plain_letters(text), r"[^\p{L}\p{N}_]+", " "))


def clipped(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def links(page: Column) -> Column:
    """Distinct targets of href attributes in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1))


def facility_name(text: Column) -> Column:
    """A place's name as a key: letters and digits apart, abbreviations spelt out."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, "([a-z])([0-9])", "$1 $2"), "([0-9])([a-z])", "$1 $2")
    parts = F.filter(F.split(F.trim(out), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in S.ABBREVIATIONS.items() for x in kv])
    spelt = lambda w: F.when((F.size(parts) > 1) & ~(w.isin("n", "s", "e", "w") & (F.size(parts) <= 2)), F.coalesce(F.try_element_at(table, w), w)).otherwise(w)
    return F.array_join(F.transform(parts, spelt), " ")


def slug(text: Column) -> Column:
    out = F.regexp_replace(facility_name(text), "^(parking lot|lot|parking garage|garage) ", "")
    out = F.regexp_replace(out, " (parking garage|garage|parking lot|lot|parking)$", "")
    return F.coalesce(F.nullif(F.replace(out, F.lit(" "), F.lit("-")), F.lit("")), F.lit("unnamed"))


def query_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def content_hash(columns: list[Column]) -> Column:
    """One digest of several values; null and empty differ, and no separator can be forged."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]), 256)


# ---- pandas functions ----

_CELL = re.compile(r"</t[dh]\s*>", re.I)
_BREAK = re.compile(r"<br\s*/?>|</(?:p|div|li|tr|h[1-6]|ul|ol|table|section|article|blockquote)\s*>", re.I)
_HIDDEN = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?-->", re.I | re.S)
_TAGS = re.compile(r"<[^>]*>")


def plain_text(page: str | None) -> str:
    """Readable text: cells apart by spaces, blocks by line ends, at most one empty line."""
    out = _BREAK.sub("\n", _CELL.sub(" ", page or ""))
    out = html.unescape(_TAGS.sub("", _HIDDEN.sub("", out))).replace("\xa0", " ")
    lines = (re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in out.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def similarity(current: str, prior: str, least: float = 0.0) -> float:
    """Of two folded texts, from 0 to 1; lengths that differ much give their ratio, and bounds below ``least`` stand for the ratio."""
    return likeness_of(Places(current), Places(prior), least)


def likeness_of(current: Places, prior: Places, least: float = 0.0) -> float:
    """``similarity`` of texts whose places of characters are kept."""
    a, b = current.text, prior.text
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    ratio = min(len(a), len(b)) / max(len(a), len(b))
    if ratio < S.LENGTH_RATIO:
        return ratio
    # a bound that is never below the ratio, and of short texts the cheaper one: a longest common subsequence
    if least > 0 and len(b) < LONG and (most := 2 * common_length(a, b) / (len(a) + len(b))) < least:
        return most
    return 2.0 * matched_length(current, prior, least) / (len(a) + len(b))


def common_length(a: str, b: str) -> int:
    """The length of a longest common subsequence, by one sum over a row of bits for each character of ``a``."""
    places: dict[str, int] = {}
    for j, char in enumerate(b):
        places[char] = places.get(char, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for char in a:
        if hit := row & places.get(char, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def spelling_only(removed, added) -> bool:
    """Every removed word has an added one that is spelt much alike."""
    return all(any(difflib.SequenceMatcher(None, r, a).ratio() >= S.SPELLING_RATIO for a in added) for r in removed)


@F.pandas_udf(StringType())
def html_to_text(page: pd.Series) -> pd.Series:
    return page.map(plain_text)


# ---- small text rules of a digest ----


def squeezed(text: Column) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def repaired_link(raw: Column, host: str = "https://example.org") -> Column:
    """A usable absolute address, or null: white space and trailing punctuation go, hosts without a scheme get one, and other schemes and anchors are refused."""
    out = F.regexp_replace(F.regexp_replace(raw, " ", " "), r"(?i)^(?:\s|&nbsp;)+|\s+$", "")
    out = F.regexp_replace(out, "[.,;]+$", "")
    return (
        F.when(F.coalesce(out, F.lit("")).rlike("^(?:#.*)?$"), F.lit(None))
        .when(out.rlike("(?i)^(?:https?://|mailto:|tel:)"), out)
        .when(out.rlike(r"(?i)^[a-z][a-z0-9+.-]*:(?!\d)"), F.lit(None))
        .when(out.startswith("//"), F.concat(F.lit("https:"), out))
        .when(out.startswith("/"), F.concat(F.lit(host), out))
        .when(out.rlike(r"(?i)^[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::\d+)?(?:[/?#]|$)"), F.concat(F.lit("https://"), out))
    )


def kept_style(style: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed declarations of a style attribute without active content, as name:value."""
    parts = F.split(F.coalesce(style, F.lit("")), ";")
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("name"), F.trim(F.regexp_extract(p, "^[^:]*:(.*)$", 1)).alias("value")))
    good = F.filter(pairs, lambda p: p["name"].isin(*allowed) & (p["value"] != "") & ~p["value"].rlike(r"(?i)expression\s*\(|url\s*\(|javascript:|@import|behavior|-moz-binding"))
    return F.array_join(F.transform(good, lambda p: F.concat(p["name"], F.lit(":"), p["value"])), ";")


def title_case(label: Column) -> Column:
    """First letters in upper case but for small words after the first."""
    word = lambda w, i: F.when(w.isin("q&a", "q&as"), F.upper(w)).when((i > 0) & w.isin(*S.SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1)))
    return F.array_join(F.transform(F.filter(F.split(squeezed(label), " "), lambda w: w != ""), word), " ")


def without_brackets(value: Column) -> Column:
    return F.regexp_replace(squeezed(F.regexp_replace(value, r"\([^)]*\)", " ")), r"^[ ,;:-]+|[ ,;:-]+$", "")


def person_line(name: Column, department: Column, job_title: Column, email: Column, phone: Column) -> Column:
    """A published contact in one line; null if nothing is known."""
    some = lambda sep, *cols: F.nullif(F.concat_ws(sep, *[F.nullif(c, F.lit("")) for c in cols]), F.lit(""))
    return some(" — ", F.nullif(name, F.lit("")), some(", ", job_title, department), some(" · ", email, phone))


def fingerprint(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def clock(minutes: Column) -> Column:
    """Minutes after midnight as a time of twelve hours."""
    hour = F.floor(minutes / 60).cast("int")
    return F.format_string("%d:%02d %s", (hour + 11) % 12 + 1, (minutes % 60).cast("int"), F.when(hour < 12, "a.m.").otherwise("p.m."))


def clamped(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def at_least(confidence: Column, minimum: Column) -> Column:
    """low, medium and high in this order; other words are below all."""
    order = F.array(*map(F.lit, ("low", "medium", "high")))
    return F.array_position(order, F.coalesce(confidence, F.lit(""))) >= F.array_position(order, minimum)


def accepted_title(raw: Column, source: Column) -> Column:
    """A suggested title of which every word stands in the source; null if it has a new one, a date, an address or is too long."""
    title = squeezed(raw)
    words_of = lambda t: F.filter(F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]+"), 0)), lambda w: ~w.isin(*S.SMALL_WORDS, "in", "on", "at", "from", "by") & ~w.rlike("^[0-9]+$"))
    bad = (title == "") | (F.length(title) > 120) | lower_ascii(title).rlike(r"http|://|@|\b\d{1,2}[/-]\d{1,2}\b|\b(19|20)\d{2}\b") | (F.size(F.array_except(words_of(title), words_of(source))) > 0)
    return F.when(~bad, title)


def record_hash(record: Column, fields: list[str], dates: Column) -> Column:
    """One digest of a record's fields and its sorted dates; null and empty differ."""
    return content_hash([*[record[f] for f in fields], F.array_join(F.transform(F.array_sort(dates), lambda d: d.cast("string")), ",")])


def instant(text: Column) -> Column:
    """A stored timestamp; one without a zone is UTC."""
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, never below zero; null if either is."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(end) - F.unix_timestamp(start)))


def description_fault(text: Column, names: Column, plain: tuple[str, ...] = S.PLAIN_CAPITALS) -> Column:
    """Why a place's description is refused, or null: empty, its length, a coordinate, praise, an address, or a capitalised name that the evidence lacks.

    names: the array of names in evidence; null is none.
    """
    value = squeezed(text)
    n = F.size(F.split(value, " "))
    parts = lambda xs: F.filter(F.flatten(F.transform(xs, lambda x: F.split(facility_name(x), " "))), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    named = parts(F.regexp_extract_all(value, F.lit(r"\b[A-Z][a-zA-Z'’]+(?:\s+[A-Z][a-zA-Z'’]+)*"), 0))
    known = F.array_union(parts(F.coalesce(names, F.array().cast("array<string>"))), F.array(*map(F.lit, plain)))
    return (
        F.when(value == "", "empty")
        .when((n < S.DESCRIPTION_WORDS[0]) | (n > S.DESCRIPTION_WORDS[1]), "length")
        .when(value.rlike(r"-?\d{2}\.\d{3,}"), "coordinate")
        .when(value.rlike(S.PRAISE), "praise")
        .when(value.rlike("https?://"), "address")
        .when(F.size(F.array_except(named, known)) > 0, "unknown name")
    )
