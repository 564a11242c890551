"""Dates in free text, as ISO text, and moves of dates along the calendar."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.columns import let

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_STARTS = [m[:3] for m in MONTHS]


def _pad(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))


def header_date(text: Column) -> Column:
    """``D-M-YYYY`` or ``YYYY-M-D`` at the beginning as ISO, not checked; anything else as it is."""
    dmy, ymd = r"^\s*(\d{1,2})-(\d{1,2})-(\d{4})", r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})"
    get = lambda p, i: F.regexp_extract(text, p, i)
    return F.when(text.rlike(dmy), _pad(get(dmy, 3), get(dmy, 2), get(dmy, 1))).when(text.rlike(ymd), _pad(get(ymd, 1), get(ymd, 2), get(ymd, 3))).otherwise(text)


def _named_date(low: Column, default_year: Column, strict: bool) -> Column:
    """ISO date of lower-case text with the name of a month; null where that is no date."""
    short = "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "september" else "sept?(?:ember)?" for m in MONTHS)
    name = rf"\b({short})\b" if strict else f"({'|'.join(_STARTS)})"
    first, then = (rf"\b(\d{{1,2}})(?:\s+of)?[\s,.-]+{name}", rf"{name}[\s,.]+(\d{{1,2}})\b") if strict else (r"^\D*(\d{1,2})\b.*?[a-z]", rf"{name}[a-z]*\D*(\d{{1,2}})")
    lead, after, year = F.regexp_extract(low, first, 1), F.regexp_extract(low, then, 2), F.regexp_extract(low, r"\b((?:19|20)\d{2})\b", 1)

    def dated(found: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in _STARTS]), F.substring(found, 1, 3)).cast("string")
        day = let(lead, lambda x: F.when(x != "", x).otherwise(let(after, lambda y: F.when(y != "", y).otherwise(F.lit("1")))))
        iso = _pad(let(year, lambda y: F.when(y != "", y).otherwise(default_year.cast("string"))), month, day)
        return F.when(found != "", let(iso, lambda d: F.when(F.try_to_date(d, "yyyy-MM-dd").isNotNull(), d)))

    return let(F.regexp_extract(low, name, 1), dated)


def normalize_date(text: Column, default_year: Column | int = 2019, mode: str = "strict") -> Column:
    """ISO date of free text; text that holds none stays as it is.

    In this order: ISO; ``YYYY-M`` (day 1); ``D/M/YYYY`` or ``D-M-YYYY``; a month
    name with a leading or else following day (or 1) and an explicit or else the
    default year, if that is a date; ``YYYY`` (January 1). ``strict`` wants whole
    month names or their first three letters (four for Sept) and never takes the
    year's digits for a day; ``compat`` takes a month's letters anywhere. Each
    step is computed once, and only for texts that no earlier one has settled.
    """
    default_year = F.lit(default_year) if isinstance(default_year, int) else default_year
    ym, dmy = r"^(\d{4})-(\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    get = lambda c, p, i: F.regexp_extract(c, p, i)

    def settled(t: Column) -> Column:
        bare = F.lower(F.regexp_replace(F.regexp_replace(t, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1"), r"(?i)\b(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\b,?\s*", ""))
        named = let(bare, lambda low: _named_date(low, default_year, mode == "strict"))
        return (
            F.when(t.isNull() | F.lower(t).isin("", "nan", "none", "null"), text)
            .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
            .when(t.rlike(ym), _pad(get(t, ym, 1), get(t, ym, 2), F.lit("1")))
            .when(t.rlike(dmy), _pad(get(t, dmy, 3), get(t, dmy, 2), get(t, dmy, 1)))
            .when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
            .otherwise(F.coalesce(named, text))
        )

    return let(F.trim(text), settled)


def stated_year(text: Column) -> Column:
    """First year of 1900 to 2099 in a text; null without one."""
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def corpus_date(text: Column) -> Column:
    """Date of a header in one of six styles, ordinals allowed; null otherwise."""
    t = F.regexp_replace(F.trim(text), r"(?i)(\d{1,2})(st|nd|rd|th)\b", "$1")
    return let(t, lambda x: F.coalesce(*[F.try_to_date(x, f) for f in ("d-M-yyyy", "d/M/yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")]))


def like_style(day: Column, style: Column) -> Column:
    """A date written as ``style`` is: ``dd-MM-yyyy`` with hyphens, ``Month 5th, yyyy`` with a comma, else ``5th Month yyyy``."""
    n = F.dayofmonth(day)
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    ordinal = F.concat(n.cast("string"), end)
    return F.when(style.contains("-"), F.date_format(day, "dd-MM-yyyy")).when(style.contains(","), F.concat(F.date_format(day, "MMMM "), ordinal, F.date_format(day, ", yyyy"))).otherwise(F.concat(ordinal, F.date_format(day, " MMMM yyyy")))


def rescale(micros: Column, low: Column, high: Column, start: int, stop: int) -> Column:
    """Microseconds moved from the range ``low..high`` to ``start..stop``, kept inside; an empty range keeps distances."""
    scale = F.when(high > low, F.lit(float(stop - start)) / (high - low).cast("double")).otherwise(F.lit(1.0))
    return F.least(F.greatest(F.lit(start) + F.floor((micros - low).cast("double") * scale), F.lit(start)), F.lit(stop)).cast("long")


def moved_year(year: Column, low: Column, high: Column, start: int, stop: int) -> Column:
    """A year of 2000 to 2050 moved as its first of July is (ranges in microseconds); any other stays."""
    there = rescale(F.unix_micros(F.make_date(year, F.lit(7), F.lit(1)).cast("timestamp")), low, high, start, stop)
    return F.when(year.between(2000, 2050), F.year(F.timestamp_micros(there))).otherwise(year)


_SHORT = f"(?:{'|'.join(_STARTS)})[a-z]*"
#: Day, month and year in the orders that mentions have, months by number, whole name or first letters.
_STYLES = [s.format(m) for s, ms in (("%d-{}-%Y", ["%m"]), ("%d/{}/%Y", ["%m"]), ("%d {} %Y", ["%B", "%b"]), ("{} %d, %Y", ["%B", "%b"])) for m in ms]
_ENDS = ["th"] + ["st", "nd", "rd"] + ["th"] * 17 + ["st", "nd", "rd"] + ["th"] * 7 + ["st"]
_DATE = rf"\b\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}\b|\b\d{{1,2}}(?:st|nd|rd|th)?\s+{_SHORT}\s+\d{{4}}\b|\b{_SHORT}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"
_YEAR = r"(?<!\d)20\d{2}(?!\d)"


class Mover:
    """Moves dates and years in running text from one range of dates to another, in the style in which they are written."""

    def __init__(self, low: datetime, high: datetime, start: datetime, stop: datetime, compat: bool = False):
        self.low, self.start, self.stop, self.compat = low, start, stop, compat
        self.scale = (stop - start).total_seconds() / (high - low).total_seconds() if high > low else 1.0
        self.either = re.compile(f"{_DATE}|{_YEAR}" if not compat else _DATE, re.IGNORECASE)

    def moved(self, day: datetime) -> datetime:
        return min(max(self.start + timedelta(seconds=(day - self.low).total_seconds() * self.scale), self.start), self.stop)

    def year(self, text: str) -> str:
        return str(self.moved(datetime(int(text), 7, 1)).year) if 2000 <= int(text) <= 2050 else text

    def one(self, found: re.Match) -> str:
        old = found[0]
        if old.isdigit():
            return self.year(old)
        bare = re.sub(r"(?i)(?<=\d)(st|nd|rd|th)\b", "", old)
        for style in _STYLES:
            try:
                day = self.moved(datetime.strptime(bare, style))
            except ValueError:
                continue
            if "-" in old:
                return f"{day:%d-%m-%Y}"
            ordinal, month = f"{day.day}{_ENDS[day.day]}", MONTHS[day.month - 1].capitalize()
            return f"{month} {ordinal}, {day.year}" if "," in old else f"{ordinal} {month} {day.year}"
        return old

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        out = self.either.sub(self.one, text)
        return re.sub(_YEAR, lambda m: self.year(m[0]), out) if self.compat else out


def moved_text(text: Column, low: datetime, high: datetime, start: datetime, stop: datetime, compat: bool = False) -> Column:
    """Text with its dates and lone years of 2000 to 2099 moved from ``low..high`` to ``start..stop``; null stays.

    Each mention moves once. ``compat`` looks for years again in what it has
    written, so that the years of moved dates move a second time. A callback for
    each match, which no built-in expression has: by Arrow batches.
    """

    def move(texts: pa.Array) -> pa.Array:
        mover = Mover(low, high, start, stop, compat)
        return pa.array([mover.text(t) for t in texts.to_pylist()], pa.string())

    move.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(move, "string")(text)
