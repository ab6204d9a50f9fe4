"""Calendar entries of event sessions as text: escaping, folding, identifiers, whole documents."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import settings as S

LINE_OCTETS = 75


def escaped(text: Column) -> Column:
    """A calendar text value: backslash, semicolon, comma and line ends escaped, other control characters gone."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[\x00-\x09\x0B-\x1F\x7F]", ""), r"([\\;,])", r"\\$1")
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def uid(*parts: Column) -> Column:
    """A stable identifier: the same entry has it in every run."""
    return F.concat(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32), F.lit("@noticeflow"))


def _moment(day: Column, minutes: Column, date_format: str, time_format: str) -> Column:
    """A day and minutes after its midnight in local time; minutes may reach into the day before or after."""
    clock = F.format_string(time_format, F.pmod(F.floor(minutes / 60).cast("int"), F.lit(24)), F.pmod(minutes, F.lit(60)).cast("int"))
    return F.concat(F.date_format(F.date_add(day, F.floor(minutes / 1440).cast("int")), date_format), clock)


def stamp(day: Column, minutes: Column) -> Column:
    """yyyyMMddTHHmmss of a day and minutes after midnight, in local time."""
    return _moment(day, minutes, "yyyyMMdd", "T%02d%02d00")


def _folded(line: str) -> str:
    raw, out = line.encode(), []
    while len(raw) > LINE_OCTETS - bool(out):
        cut = LINE_OCTETS - bool(out)
        while raw[cut] & 0xC0 == 0x80:  # not inside a character
            cut -= 1
        out.append(raw[:cut])
        raw = raw[cut:]
    return b"\r\n ".join([*out, raw]).decode()


@F.pandas_udf(StringType())
def fold_lines(lines: pd.Series) -> pd.Series:
    """Lines of at most 75 octets, continued by a space, ended by CR LF."""
    return lines.map(lambda own: "".join(_folded(x) + "\r\n" for x in own), na_action="ignore")


def document(title: Column, day: Column, start: Column, end: Column, location: Column, description: Column, key: Column) -> Column:
    """One calendar document for each row; a missing end is an hour after the start."""
    until = F.coalesce(end, start + 60)
    one = lambda name, value: F.array(F.concat(F.lit(name), value))
    some = lambda name, text: F.when(F.coalesce(text, F.lit("")) != "", one(f"{name}:", escaped(text))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(*map(F.lit, ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//noticeflow//EN", "BEGIN:VEVENT"))), one("UID:", uid(key, day, start)), one("DTSTAMP:", F.concat(F.date_format(day, "yyyyMMdd"), F.lit("T000000Z"))),
        one("DTSTART:", stamp(day, start)), one("DTEND:", stamp(day, until)), one("SUMMARY:", escaped(title)), some("LOCATION", location), some("DESCRIPTION", description), F.array(F.lit("END:VEVENT"), F.lit("END:VCALENDAR")),
    )
    return F.when(day.isNotNull() & start.isNotNull(), fold_lines(lines))


def zone_lines() -> list[str]:
    """The definition of the calendar's zone: its two changes of the clock, each a yearly rule."""
    changes = [[f"BEGIN:{part}", f"TZOFFSETFROM:{before}", f"TZOFFSETTO:{after}", f"TZNAME:{name}", f"DTSTART:{since}", f"RRULE:FREQ=YEARLY;BYMONTH={month};BYDAY={weekday}", f"END:{part}"] for part, before, after, name, since, month, weekday in S.ZONE_CHANGES]
    return ["BEGIN:VTIMEZONE", f"TZID:{S.ZONE}", f"X-LIC-LOCATION:{S.ZONE}", *sum(changes, []), "END:VTIMEZONE"]


def _clock12(minutes: Column) -> Column:
    hour = F.pmod(F.floor(minutes / 60).cast("int"), F.lit(24))
    return F.format_string("%d:%02d %s", F.pmod(hour + 11, F.lit(12)) + 1, F.pmod(minutes, F.lit(60)).cast("int"), F.when(hour < 12, "AM").otherwise("PM"))


def with_travel(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blocks``, array of struct(kind, suffix, start, end, summary, description), and ``document``: each session with a hold for the way there and one for the way back.

    rows: notice, content_hash, title, event_date, start_min, end_min, session_count, location, description, address, minutes_before, minutes_after, mode.
    The event keeps its stated times, and a hold lies next to it, perhaps on the day before or after; minutes that are null or
    not above 0 make none.  A missing end is an hour after the start.  Identifiers are made of the notice, its content and the
    block, with the date where a notice has several sessions, so the same entry has them in every run.  Without a day or a start
    there is no document and no block.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    start, until, title = F.col("start_min"), F.coalesce("end_min", F.col("start_min") + 60), text(F.col("title"))
    place, verb = F.coalesce(F.nullif(F.col("location"), F.lit("")), title), F.when(F.col("mode") == "drive", "Drive").otherwise("Travel")

    def block(kind: str, suffix: str, begin: Column, end: Column, summary: Column, limit: int, description: Column) -> Column:
        dated = F.when(F.col("session_count") > 1, F.concat(F.lit(f"{suffix}-"), F.date_format("event_date", "yyyy-MM-dd"))).otherwise(suffix)
        return F.struct(F.lit(kind).alias("kind"), dated.alias("suffix"), begin.cast("int").alias("start"), end.cast("int").alias("end"), safe_text(summary, limit).alias("summary"), description.alias("description"))

    said = lambda name, *values: F.format_string(S.TRAVEL_TEXTS[name], *values)
    way_there = block("travel_outbound", "travel-out", start - F.col("minutes_before"), start, F.concat_ws(" to ", verb, place), S.HOLD_CHARS, said("outbound", title, _clock12(start)))
    way_back = block("travel_return", "travel-back", until, until + F.col("minutes_after"), F.concat_ws(" from ", verb, place), S.HOLD_CHARS, said("return", title, _clock12(until)))
    event = block("event", "event", start, until, title, S.LINK_FIELD_CHARS, text(F.col("description")))
    blocks = F.array_compact(F.array(F.when(F.col("minutes_before") > 0, way_there), event, F.when(F.col("minutes_after") > 0, way_back)))

    def lines(b: Column) -> Column:
        seed = F.concat_ws(":", F.col("notice").cast("string"), text(F.col("content_hash")), b["suffix"])
        moment = lambda name, at: F.concat(F.lit(f"{name};TZID={S.ZONE}:"), stamp(F.col("event_date"), at))
        some = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}:"), escaped(value)))
        return F.array_compact(F.array(
            F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.substring(F.sha2(seed, 256), 1, 32), F.lit("-"), b["suffix"], F.lit("@noticeflow")), F.concat(F.lit("DTSTAMP:"), F.date_format("event_date", "yyyyMMdd"), F.lit("T000000Z")),
            moment("DTSTART", b["start"]), moment("DTEND", b["end"]), F.concat(F.lit("SUMMARY:"), escaped(b["summary"])), some("DESCRIPTION", b["description"]), some("LOCATION", text(F.col("location"))),
            F.when(b["kind"] == "event", some("URL", text(F.col("address")))), F.lit("TRANSP:OPAQUE"), F.concat(F.lit("X-NOTICEFLOW-BLOCK:"), b["kind"]), F.lit("END:VEVENT"),
        ))

    fixed = lambda values: F.array(*map(F.lit, values))
    head = fixed(["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//noticeflow//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", *zone_lines()])
    known = F.col("event_date").isNotNull() & F.col("start_min").isNotNull()
    out = rows.withColumn("blocks", F.when(known, blocks))
    return out.withColumn("document", F.when(known, fold_lines(F.concat(head, F.flatten(F.transform("blocks", lines)), fixed(["END:VCALENDAR"])))))


#: The pieces of a title, each with the space before it: brackets, separators that stand apart, words.
_PIECE = r" ?(?:\[[^\]]*\]|\([^()]*\)|[-–—:|,;]+(?= |$)|[^\s\[\]()]+|\S)"
_EDGES, _DATE_EDGES = " -–—:|,;", " -–—:|,;()[]"
#: Over the pieces' letters (see ``_letter``): what may go in front, where something follows, and what may go behind.
_FRONT = "^(?:S+|BS?|e|ES|L+S|L*l|pS)(?=.)"
_DATE = "K?(?:MNY?|X)"
_BEHIND = f"S?(?:{_DATE}|D)$"


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.transform(F.array(value), f)[0]


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1C-\x1F]+", " "))


def _date_letter(word: Column) -> Column:
    """What a word is in a date: Month, weeKday, Number of a day, Year or a date in figures (X); W otherwise."""
    bare = F.lower(F.btrim(word, F.lit(".,")))
    months = [n for m in S.MONTHS for n in {m, m[:3]}] + ["sept"]
    days = [n for d in S.WEEKDAYS for n in {d, d[:3]}] + ["tues", "thur", "thurs"]
    return (
        F.when(bare.isin(*months), "M").when(bare.isin(*days), "K").when(bare.rlike("^[0-9]{1,2}(?:st|nd|rd|th)?$"), "N").when(bare.rlike("^[0-9]{4}$"), "Y")
        .when(bare.rlike("^[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?$"), "X").otherwise("W")
    )


def _letter(piece: Column) -> Column:
    """A piece's kind: Bracket, p (shouted) or P for round ones, D for either with a date, Separator, the word Event (e with its colon), Loud words (l with a colon), dates, W."""
    w = F.trim(piece)
    inner = F.trim(F.substring(w, F.lit(2), F.length(w) - 2))
    dated = F.array_join(F.transform(F.split(inner, " "), _date_letter), "").rlike(f"^{_DATE}$")
    loud = r"[A-Z][A-Z&/'-]*"
    bracket = (
        F.when(dated & (F.length(w) > 2), "D")
        .when(w.startswith("["), F.when(F.length(w).between(3, 32), "B").otherwise("W"))
        .when(inner.rlike(rf"^{loud}(?: [A-Z&/'-]+)*$"), "p")
        .otherwise("P")
    )
    return (
        F.when(w.rlike(r"^(?:\[[^\]]*\]|\([^()]*\))$"), bracket).when(w.rlike("^[-–—:|,;]+$"), "S").when(F.lower(w) == "event", "E").when(F.lower(w) == "event:", "e")
        .when(_date_letter(w) != "W", _date_letter(w)).when(w.rlike(f"^{loud}$"), "L").when(w.rlike(f"^{loud}:$"), "l").otherwise("W")
    )


def _pieces(title: Column) -> Column:
    """struct(words, kinds): a title's pieces and their letters."""
    words = F.regexp_extract_all(title, F.lit(_PIECE), F.lit(0))
    return F.struct(words.alias("words"), F.array_join(F.transform(words, _letter), "").alias("kinds"))


def _named(text: Column) -> Column:
    return (F.length(text) >= 3) & text.rlike("[A-Za-z]")


def _first_kept(p: Column) -> Column:
    """How many pieces in front go: group by group, a loud label only with 3 to 25 characters."""
    words, kinds = p["words"], p["kinds"]

    def step(at: Column, _: Column) -> Column:
        group = F.regexp_extract(F.substring(kinds, at + 1, F.length(kinds)), _FRONT, 0)
        said = F.regexp_replace(F.array_join(F.slice(words, at + 1, F.length(group)), ""), r"^[ (]+|[-–—: )]+$", "")
        fits = ~group.rlike("[Llp]") | F.length(said).between(3, 25)
        return at + F.when(fits, F.length(group)).otherwise(0)

    return F.aggregate(words, F.lit(0), step)


def _front_gone(title: Column) -> Column:
    return _let(_pieces(title), lambda p: F.array_join(F.slice(p["words"], _first_kept(p) + 1, F.greatest(F.size(p["words"]), F.lit(1))), ""))


def _behind_gone(title: Column) -> Column:
    """Without a date at the end, where a name is left; else with last words in brackets after a dash, if they say what the event is and not how to attend it."""

    def changed(p: Column) -> Column:
        words, kinds = p["words"], p["kinds"]
        kept = F.size(words) - F.length(F.regexp_extract(kinds, _BEHIND, 0))
        bare = F.btrim(F.array_join(F.slice(words, F.lit(1), kept), ""), F.lit(_DATE_EDGES))
        head = F.btrim(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), ""), F.lit(_EDGES))
        last = F.trim(F.element_at(words, -1))
        tail = F.trim(F.substring(last, F.lit(2), F.length(last) - 2))
        other = F.btrim(F.lower(tail), F.lit(" .")).isin(*S.PLAIN_QUALIFIERS) | tail.rlike("[0-9]{1,2}[/-][0-9]{1,2}")
        says = kinds.rlike("[Pp]$") & F.length(last).between(5, 42) & tail.rlike("[A-Za-z]") & ~other
        return F.when((kept < F.size(words)) & _named(bare), bare).when(says & _named(head), F.concat_ws(" - ", head, tail)).otherwise(title)

    return F.when(title != "", _let(_pieces(title), changed)).otherwise(title)


def clean_title(title: Column, fallback: Column | None = None) -> Column:
    """A title without labels in front, a date behind and edge punctuation, until nothing more goes; an empty one gives the fallback as it is.

    The title is cut into pieces, and what goes is told by their kinds and places.
    Each turn that changes a title uses up a space, a separator or a bracket, so their number bounds the turns.
    """
    given, other = F.nullif(_spaced(title), F.lit("")), _spaced(fallback if fallback is not None else F.lit(""))
    turn = lambda t: _spaced(F.btrim(_let(F.btrim(_front_gone(t), F.lit(_EDGES)), _behind_gone), F.lit(_EDGES)))

    def settled(x: Column) -> Column:
        most = F.regexp_count(x, F.lit(r"[\s:\[|/,;–—-]")) + 4 * F.regexp_count(x, F.lit(r"\(")) + 1
        start = F.struct(x.alias("now"), F.lit(None).cast("string").alias("before"))
        step = lambda acc, _: F.when(acc["now"].eqNullSafe(acc["before"]), acc).otherwise(F.struct(turn(acc["now"]).alias("now"), acc["now"].alias("before")))
        return F.coalesce(F.nullif(F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["now"]), F.lit("")), x)

    return F.coalesce(_let(given, settled), other)


def safe_text(text: Column, limit: int | None = None) -> Column:
    """A text without control characters, blanks at line ends and runs of empty lines; cut at a limit with an ellipsis."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?m)[ \t]+$", "")
    out = F.regexp_replace(out, r"^\s+|\s+\z", "")
    return out if limit is None else _let(out, lambda o: F.when(F.length(o) > limit, F.concat(_right_trimmed(F.substring(o, 1, limit)), F.lit("…"))).otherwise(o))


def _right_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


def _encoded(text: Column) -> Column:
    """Percent-encoded, a space as %20."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def deep_link(base: str, title: Column, day: Column, start: Column, end: Column, location: Column, description: Column) -> Column:
    """An address that opens a calendar's form for one session; null without a day or a start.

    A missing end is an hour after the start.  What is too long before it is encoded isn't encoded.  An address that is too long
    loses three tenths of its description at a time down to a short one, and
    then all of it; no other field is cut for that.
    """
    local = lambda minutes: _moment(day, minutes, "yyyy-MM-dd", "T%02d:%02d:00")
    field = lambda name, value: F.concat(F.lit(f"&{name}="), _encoded(value))
    some = lambda name, value: F.when(value != "", field(name, value)).otherwise("")
    fixed = F.concat(
        F.lit(f"{base}?path="), _encoded(F.lit(S.COMPOSE_PATH)), F.lit("&rru=addevent"), field("startdt", local(start)), field("enddt", local(F.coalesce(end, start + 60))),
        field("subject", safe_text(title, S.LINK_FIELD_CHARS)), some("location", safe_text(location, S.LINK_FIELD_CHARS)),
    )

    def fitted(x: Column) -> Column:
        turns = F.greatest(F.ceil(F.ln(F.greatest(F.length(x["body"]), F.lit(1)) / (S.LINK_BODY_CHARS - 4)) / -math.log(S.LINK_SHRINK)) + 1, F.lit(1)).cast("int")
        whole = lambda b: F.concat(x["fixed"], some("body", b))
        shorter = lambda b: F.concat(_right_trimmed(F.substring(b, F.lit(1), F.floor(F.length(b) * S.LINK_SHRINK).cast("int"))), F.lit("…"))
        step = lambda b, _: F.when((F.length(b) > S.LINK_BODY_CHARS) & ((F.length(b) > S.LINK_CHARS) | (F.length(whole(b)) > S.LINK_CHARS)), shorter(b)).otherwise(b)
        return F.aggregate(F.sequence(F.lit(1), turns), x["body"], step, lambda b: _let(whole(b), lambda u: F.when(F.length(u) > S.LINK_CHARS, x["fixed"]).otherwise(u)))

    return F.when(day.isNotNull() & start.isNotNull(), _let(F.struct(fixed.alias("fixed"), safe_text(description).alias("body")), fitted))
