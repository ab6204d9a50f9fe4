"""Dates, times and repeating schedules in prose: a line is read into words and their kinds once, and all that is looked for are shapes of kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S
from . import text as T

_MONTH_NO = {name[:n]: i for i, name in enumerate(S.MONTHS, 1) for n in (3, len(name))} | {"sept": 9}
_DAY_NO = {name[:n]: i for i, name in enumerate(S.WEEKDAYS) for n in (3, len(name))} | {"tues": 1, "thur": 3, "thurs": 3}
#: Kinds of words by their text: Months, weekdays (K, and Q where the short form reads as a plural), their Plurals, Repeating words and so on.
_KNOWN = (
    {f"{d}s": "P" for d in _DAY_NO} | {d: "Q" if d[:-1] in _DAY_NO and d[-1] == "s" else "K" for d in _DAY_NO} | dict.fromkeys(_MONTH_NO, "M")
    | dict.fromkeys(("mwf", "tth", "tuth"), "R") | {"every": "E", "each": "e", "other": "o", "ongoing": "g", "to": "t", "through": "t", "until": "u", "till": "u", "thru": "h"}
    | dict.fromkeys(("st", "nd", "rd", "th"), "O") | {"a": "a", "p": "a", "m": "m", "w": "w", "f": "f"}
)
#: Kinds of words by how they begin, the first that fits.
_BEGINNING = {"weekly": "R", "biweekly": "R", "monthly": "R", "recurring": "R", "week": "k", "series": "S", "am": "A", "pm": "A", "m": "n", "f": "f"}
_MARKS = {" ": "s", "/": "/", ":": ":", ".": ".", ",": ","}
_TOKEN = r"(?s)[0-9]+|[\p{L}_]+|\s+|-+|."
_NUMBERS, _WORDS = "NTLYV", "MKQPREekogtuhOamnwfASW"  # one digit, two, three, four, more; the letters of all words
_PLACE = 9


def _shape(atoms: str, after: str = "") -> str:
    """A pattern over kinds: each atom is one token of one of its letters, with its place; ``after`` lists the kinds that may not come before."""
    text = re.sub(r"[A-Za-z.,:/-]+", lambda m: rf"(?:[{m[0]}][0-9]{{{_PLACE}}})", atoms).replace(" ", "")
    return (rf"(?<![{after}][0-9]{{{_PLACE}}})" if after else "") + text


_HALF = "(A .? | a .? s? mn .?)"
#: A month's name, a day and perhaps a year, perhaps after a weekday.
LONG_DATE = _shape("(KQ s? ,? s)? M .? s NT O? (s? ,? s? YV)?", _NUMBERS)
SHORT_DATE = _shape("NT / NT (/ TLY)?", _WORDS) + f"(?![{_WORDS}])"
#: A longer number may begin a range by its last two digits and end one by its first two.
RANGE = _shape(f"({_NUMBERS} : T | {_NUMBERS}) s? {_HALF}? s? -tu s? (NT : T s? {_HALF} | NT : {_NUMBERS[1:]} | NT s? {_HALF} | {_NUMBERS})")
SINGLE_TIME = _shape(f"NT : (T s? {_HALF} | {_NUMBERS[1:]})", _WORDS)
_DAY_SPAN = "KQ s? -th s? KQ"
RECURRENCE = _shape(f"(PQR | E s KQk | e s k | E s o s k | g s S | m s? / s? w s? / s? f | {_DAY_SPAN})", _NUMBERS)


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.transform(F.array(value), f)[0]


def folded(text: Column) -> Column:
    """Lower case without accents, plain quotes, one space for white space within a line."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’“” ", "''\"\" ")
    return F.trim(F.regexp_replace(T.plain_letters(plain), r"[ \t\r\f\x0B]+", " "))


def lookup(table: dict, key: Column) -> Column:
    """A fixed table's value of a key; the table is one literal of plain words and numbers."""
    return F.try_element_at(F.expr(f"map({', '.join(repr(x) for kv in table.items() for x in kv)})"), key)


def _kind(word: Column) -> Column:
    number = F.substring(F.lit(_NUMBERS), F.least(F.length(word), F.lit(len(_NUMBERS))), F.lit(1))
    begins = F.lit("W")
    for start, kind in reversed(_BEGINNING.items()):
        begins = F.when(word.startswith(start), kind).otherwise(begins)
    # the word is told by its first character, so that each asks few questions
    return F.when(word.rlike("^[0-9]"), number).when(word.rlike(r"^[\p{L}_]"), F.coalesce(lookup(_KNOWN, word), begins)).when(word.rlike("^[-‐-―]"), "-").when(word.rlike(r"^\s"), "s").otherwise(F.coalesce(lookup(_MARKS, word), F.lit("x")))


def near_numbers(line: Column) -> Column:
    """A line in which long stretches without digits keep only what stands near the numbers: no date and no time is lost, nor does a gap become short."""
    return F.regexp_replace(line, r"([^0-9]{30})[^0-9]+([^0-9]{40})", "$1 ~ $2")


def read(line: Column) -> Column:
    """struct(words, kinds) of a folded line: its words, numbers, marks and spaces, and for each its kind with its place from 1."""
    words = F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0))
    kinds = lambda w: F.array_join(F.transform(w, lambda x, i: F.concat(_kind(x), F.lpad((i + 1).cast("string"), _PLACE, "0"))), "")
    return _let(words, lambda w: F.struct(w.alias("words"), kinds(w).alias("kinds")))


def numbered_lines(text: Column) -> Column:
    """array of struct(chars, words, kinds): the lines of a text that hold a digit, folded and read; of long ones what stands near their numbers."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), folded), lambda x: x.rlike("[0-9]"))
    shown = lambda x: F.when(F.length(x) > S.MAX_SESSION_LINE, near_numbers(x)).otherwise(x)
    return F.transform(F.transform(lines, lambda x: F.struct(F.length(x).alias("chars"), read(shown(x)).alias("r"))), lambda s: F.struct(s["chars"], s["r"]["words"].alias("words"), s["r"]["kinds"].alias("kinds")))


def _hits(kinds: Column, shape: str) -> Column:
    return F.regexp_extract_all(kinds, F.lit(shape), F.lit(0))


def _place(hit: Column, letters: str) -> Column:
    return F.regexp_extract(hit, rf"[{letters}]([0-9]{{{_PLACE}}})", 1).try_cast("int")


def _word(x: Column, hit: Column, letters: str) -> Column:
    """The hit's first word of a kind; null if it has none."""
    return F.try_element_at(x["words"], _place(hit, letters))


def begins(hit: Column) -> Column:
    """The place of a hit's first word."""
    return F.substring(hit, 2, _PLACE).cast("int")


def ends(hit: Column) -> Column:
    """The place after a hit's last word."""
    return begins(hit) + F.floor(F.length(hit) / (_PLACE + 1)).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if the calendar has none such."""
    last = F.when(month == 2, F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)).otherwise(31 - (month - 1) % 7 % 2)
    return F.when((year >= 1) & month.between(1, 12) & day.between(1, last), F.make_date(year, month, day))


def _long(x: Column) -> Column:
    """array of struct(month, day, year, weekday, hit) of the dates with a month's name; no year and no weekday are null."""
    return F.transform(_hits(x["kinds"], LONG_DATE), lambda h: F.struct(
        lookup(_MONTH_NO, _word(x, h, "M")).alias("month"), _word(x, h, "NT").cast("int").alias("day"), F.substring(_word(x, h, "YV"), 1, 4).cast("int").alias("year"),
        lookup(_DAY_NO, _word(x, h, "KQ")).alias("weekday"), h.alias("hit"),
    ))


def _short(x: Column) -> Column:
    """The same of dates in figures, not inside of long ones; a year of two digits is of this century."""

    def one(hit: Column) -> Column:
        at = begins(hit)
        word = lambda i: F.try_element_at(x["words"], at + i).cast("int")
        year = F.when(ends(hit) - at > 3, word(4))
        return F.struct(word(0).alias("month"), word(2).alias("day"), F.when(year < 100, year + 2000).otherwise(year).alias("year"), F.lit(None).cast("int").alias("weekday"), hit.alias("hit"))

    return F.transform(_hits(F.regexp_replace(x["kinds"], LONG_DATE, "s" + "0" * _PLACE), SHORT_DATE), one)


def dates(x: Column, reference: Column) -> Column:
    """array of struct(day, by_weekday, hit) of a line's dates; without a year the next such day, with a day's slack.

    A weekday that contradicts its date refutes it.
    """
    now = F.year(reference)

    def possible(d: Column) -> Column:
        first = _date(F.coalesce(d["year"], now), d["month"], d["day"])
        return F.struct(first.alias("first"), F.when(d["year"].isNull(), _date(now + 1, d["month"], d["day"])).alias("next"), d.alias("d"))

    def chosen(p: Column) -> Column:
        day = F.when(p["d"]["year"].isNotNull() | (p["first"] >= F.date_sub(reference, 1)), p["first"]).otherwise(p["next"])
        return F.struct(day.alias("day"), p["d"]["weekday"].alias("weekday"), p["d"]["hit"].alias("hit"))

    right = F.filter(F.transform(F.transform(F.concat(_long(x), _short(x)), possible), chosen), lambda c: c["day"].isNotNull() & (c["weekday"].isNull() | (F.weekday(c["day"]) == c["weekday"])))
    return F.transform(right, lambda c: F.struct(c["day"], c["weekday"].isNotNull().alias("by_weekday"), c["hit"]))


def date_tokens(text: Column) -> Column:
    """The days that a text names, as MM-DD or YYYY-MM-DD, distinct and sorted: no year is inferred."""
    padded = lambda n, width: F.lpad(n.cast("string"), width, "0")

    def token(d: Column) -> Column:
        return F.when(d["month"].between(1, 12) & d["day"].between(1, 31), F.concat_ws("-", padded(d["year"], 4), padded(d["month"], 2), padded(d["day"], 2)))

    line = near_numbers(F.regexp_replace(folded(text), r"\s+", " "))
    return F.array_sort(F.array_distinct(F.array_compact(_let(read(line), lambda x: F.transform(F.concat(_long(x), _short(x)), token)))))


def _minutes(clock: Column, half: Column) -> Column:
    """Minutes after midnight; without a half of the day 1 to 7 are in the afternoon."""
    h, m = clock["hour"], clock["minute"]
    by_half = F.when(h <= 12, h % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(h)
    h24 = F.when(half.isNotNull(), by_half).when(h.between(1, 7), h + 12).otherwise(h)
    return F.when((h <= 23) & (m <= 59), h24 * 60 + m)


def _clock(x: Column, kinds: Column, first: bool) -> Column:
    """struct(hour, minute, half: a, p or null) of one clock's kinds; of a longer number the two digits at the dash count."""
    number, colon = _word(x, kinds, _NUMBERS), _place(kinds, ":")
    hour = F.right(number, F.lit(2)) if first else F.substring(number, 1, 2)
    minute = F.substring(F.try_element_at(x["words"], colon + 1), 1, 2)
    return F.struct(hour.try_cast("int").alias("hour"), F.coalesce(minute.try_cast("int"), F.lit(0)).alias("minute"), F.substring(_word(x, kinds, "Aa"), 1, 1).alias("half"))


def time_ranges(x: Column) -> Column:
    """array of struct(start, end, hit): minutes of a line's ranges; a half of the day at the end holds for both."""
    sides = F.transform(_hits(x["kinds"], RANGE), lambda h: F.struct(h.alias("hit"), F.split(h, _shape("-tu")).alias("of")))
    clocks = F.transform(sides, lambda s: F.struct(s["hit"], _clock(x, s["of"][0], True).alias("a"), _clock(x, s["of"][1], False).alias("b")))
    minutes = F.transform(clocks, lambda c: F.struct(
        _minutes(c["a"], F.coalesce(c["a"]["half"], c["b"]["half"])).alias("start"), _minutes(c["b"], c["b"]["half"]).alias("end"), c["b"]["half"].isNull().alias("open"), c["hit"],
    ))
    late = lambda m: (m["end"] <= m["start"]) & m["open"] & (m["end"] + 720 < 1440)
    ranges = F.transform(minutes, lambda m: F.struct(m["start"], F.when(late(m), m["end"] + 720).otherwise(m["end"]).alias("end"), m["hit"]))
    return F.filter(ranges, lambda r: r["end"] > r["start"])


def time_of_day(x: Column) -> Column:
    """Minutes of a line's first time of day; null if there is none."""
    return F.try_element_at(F.array_compact(F.transform(F.transform(_hits(x["kinds"], SINGLE_TIME), lambda h: _clock(x, h, True)), lambda c: _minutes(c, c["half"]))), F.lit(1))


def first_time(line: Column) -> Column:
    """Minutes of a folded text's first time of day; null if there is none."""
    return _let(read(near_numbers(line)), time_of_day)


def repeating(x: Column) -> Column:
    """A line's words name a schedule that repeats: weekdays in the plural or in a span, "every" with a weekday or a week, "each week", or a word for it."""
    return x["kinds"].rlike(RECURRENCE)


def recurs(text: Column) -> Column:
    """The schedule repeats rather than happening once."""
    return _let(read(F.regexp_replace(folded(text), r"\s+", " ")), repeating)
