"""Dates in the forms that the pages' ``new Date(text)`` takes (SCA2, FLT6), as column expressions.

The pages run on V8, whose reader takes more than ISO texts. Two grammars are
tried in turn, as there:

* ISO: ``2024``, ``2024-01``, ``2024-01-10``, with a time ``T05:00``,
  ``T05:00:00`` or ``T05:00:00.123`` and a zone ``Z`` or ``±hh:mm``, with years
  of four digits or of six with a sign. ``T24:00`` is the next midnight. Day 29
  to 31 of a shorter month is rejected by neither grammar: it rolls over.
* the older free form: up to three numbers, with or without a month's name, an
  optional time ``h:mm[:ss[.fff]] [am|pm]`` and an optional zone (``Z``, ``GMT``,
  ``UTC``, North American names; behind a time or a name ``±hhmm``, too). Words
  in front that are no month's name, the names of week days among them, and
  remarks in parentheses are passed over. Numbers that are missing count as 1.
  Numbers alone mean month, day, year (``10/01/2024`` is 1 October), or year,
  month, day if the first one can be no day; beside a name they mean day, year,
  or year, day. Years 0 to 49 are 2000 to 2049, 50 to 99 are 1950 to 1999.

Texts without a zone are read in the session's zone, UTC; a date-only ISO text
is UTC by rule. Anything else is no date: null. The numbers are cut out by one
regular expression a grammar, each looked at once. Every value that is named
more than once is bound by ``let``: a column expression named twice is computed
twice, and nested ones multiply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first three letters of the months' names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Zone names and their hours from UTC.
ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}

ISO = (
    r"^([+-]\d{6}|\d{4})(?:-(\d{2})(?:-(\d{2}))?)?"
    r"(?:[Tt](\d{2}):(\d{2})(?::(\d{2})(?:[.](\d{1,9})\d*)?)?([Zz]|[+-]\d{2}:\d{2})?)?$"
)
NAME = rf"({'|'.join(MONTHS)})[a-z]*[.]?"
TIME = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.](\d{1,9})\d*)?)?"
MARK = r"(?:\s*\b(am|pm)\b)?"
ZONE = rf"(?:(?:\s*\b|(?<=\d)(?=z))({'|'.join(sorted(ZONES, key=len, reverse=True))})\b)?(?:\s*([+-])(\d{{1,2}}):?(\d{{2}})?)?"
CLOCK = rf"(?:[\s,]+{TIME}{MARK})?\s*{ZONE}\s*$"
# Groups: three of the date, then the clock's nine.
NUMBERS = rf"^(\d{{1,6}})(?:\s*[/\s.-]\s*(\d{{1,6}}))?(?:\s*[/\s.,-]\s*(\d{{1,6}}))?{CLOCK}"
NAME_FIRST = rf"^{NAME}[\s,-]*(\d{{1,6}})(?:[\s,/-]+(\d{{1,6}}))?{CLOCK}"
NUMBER_FIRST = rf"^(\d{{1,6}})[\s,/-]*{NAME}(?:[\s,/-]*(\d{{1,6}}))?{CLOCK}"
# Words in front of the date, but for months' names.
WORDS = rf"^(?:(?!(?:{'|'.join(MONTHS)}))[a-z\u00df-\u00ff]+[.]?[\s,]+)+"

# Times that a date value of the pages can hold: 100,000,000 days to either side of 1970.
MOST_SECONDS = 8_640_000_000_000
# The last number that can be a day, before the month is known.
LAST_DAY = 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _let_all(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` of several values, each computed once."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), lambda s: body(*[s.getField(k) for k in values]))


def _number(digits: Column) -> Column:
    """Digits as a number; an empty or missing group is null."""
    return F.when(digits != "", digits).cast("long")


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a day of the proleptic Gregorian calendar; days past the month's end roll over.

    March starts the year, so the leap day is its last day and every month
    begins after a whole number of fifths of 153 days.
    """
    shifted = year - F.when(month <= 2, 1).otherwise(0)
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    return let(shifted, lambda y: y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + of_year - 719_468)


def _seconds(year, month, day, hour, minute, second, offset) -> Column:
    return days_from_civil(year, month, day) * 86_400 + hour * 3_600 + minute * 60 + second - offset


def _micros(digits: Column) -> Column:
    """Milliseconds of a fraction's digits, in microseconds: the pages' dates hold no more."""
    return F.when(F.coalesce(digits, F.lit("")) != "", F.rpad(F.substring(digits, 1, 3), 3, "0").cast("long") * 1000).otherwise(F.lit(0).cast("long"))


def _stamp(seconds: Column, micros: Column, good: Column) -> Column:
    return let(F.when(good, seconds), lambda s: F.when(F.abs(s) <= MOST_SECONDS, F.timestamp_micros(s * 1_000_000 + micros)))


def _matched(raw: Column, pattern: str, groups: int, read: Callable[[Column], Column]) -> Column:
    """``read`` of the groups of the first match, as an array; null if there is none."""
    mark = "\u0001"
    joined = F.regexp_replace(raw, pattern, mark.join(f"${i}" for i in range(1, groups + 1)))
    return F.when(raw.rlike(pattern), let(F.split(joined, mark, -1), read))


def iso_timestamp(raw: Column) -> Column:
    """A text of the ISO grammar; null for any other."""

    def read(g: Column) -> Column:
        part = lambda i: F.get(g, F.lit(i))
        zone = part(7)
        return _let_all(
            stamp,
            year=_number(F.regexp_replace(part(0), r"^\+", "")),
            month=F.coalesce(_number(part(1)), F.lit(1)),
            day=F.coalesce(_number(part(2)), F.lit(1)),
            hour=F.coalesce(_number(part(3)), F.lit(0)),
            minute=F.coalesce(_number(part(4)), F.lit(0)),
            second=F.coalesce(_number(part(5)), F.lit(0)),
            micros=_micros(part(6)),
            sign=F.when(zone.startswith("-"), -1).otherwise(1),
            far=zone.rlike("^[+-]"),
            zone_hour=_number(F.substring(zone, 2, 2)),
            zone_minute=_number(F.substring(zone, 5, 2)),
            known=part(0) != "-000000",
        )

    def stamp(year, month, day, hour, minute, second, micros, sign, far, zone_hour, zone_minute, known) -> Column:
        offset = F.when(far, sign * (zone_hour * 3_600 + zone_minute * 60)).otherwise(0)
        midnight = (hour == 24) & (minute == 0) & (second == 0) & (micros == 0)
        good = month.between(1, 12) & day.between(1, 31) & ((hour < 24) | midnight) & (minute < 60) & (second < 60)
        good = good & known & (~far | ((zone_hour < 24) & (zone_minute < 60)))
        return _stamp(_seconds(year, month, day, hour, minute, second, offset), micros, good)

    return _matched(raw, ISO, 8, read)


def _clock(g: Column, first: int) -> Column:
    """(seconds of the day less the zone's, microseconds, whether valid) of the clock's groups from ``first`` on, as a struct."""
    part = lambda i: F.get(g, F.lit(first + i))
    mark, name = part(4), part(5)

    def read(hour, minute, second, sign, hours, minutes, named) -> Column:
        twelve = F.when((mark == "am") & (hour == 12), 0).when((mark == "pm") & (hour < 12), hour + 12).otherwise(hour)
        midnight = (hour == 24) & (minute == 0) & (second == 0) & (mark == "")
        good = (minute < 60) & (second < 60) & F.when(mark != "", hour.between(0, 12)).otherwise((hour < 24) | midnight)
        # A number behind the sign is hours, of three digits or more hours and minutes.
        # It needs a time or a name before it.
        good = good & ((part(6) == "") | (part(0) != "") | (name != ""))
        offset = named * 3_600 + F.coalesce(sign * (hours * 3_600 + F.coalesce(minutes, F.lit(0)) * 60), F.lit(0))
        seconds = twelve * 3_600 + minute * 60 + second - offset
        return F.struct(seconds.alias("seconds"), _micros(part(3)).alias("micros"), good.alias("good"))

    return _let_all(
        read,
        hour=F.coalesce(_number(part(0)), F.lit(0)),
        minute=F.coalesce(_number(part(1)), F.lit(0)),
        second=F.coalesce(_number(part(2)), F.lit(0)),
        sign=F.when(part(6) == "-", -1).otherwise(1),
        hours=_number(part(7)),
        minutes=_number(part(8)),
        named=F.element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), F.when(name != "", name).otherwise(F.lit("z"))),
    )


def _full_year(year: Column) -> Column:
    """Years 0 to 49 are 2000 to 2049, 50 to 99 are 1950 to 1999."""
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


def free_timestamp(raw: Column) -> Column:
    """A text of the free form; null for any other."""

    def dated(clean: Column, pattern: str, order) -> Column:
        def stamp(year, month, day, clock) -> Column:
            good = clock.getField("good") & month.between(1, 12) & day.between(1, LAST_DAY)
            seconds = days_from_civil(year, month, day) * 86_400 + clock.getField("seconds")
            return _stamp(seconds, clock.getField("micros"), good)

        def read(g: Column) -> Column:
            date = order(*[F.get(g, F.lit(i)) for i in range(3)])
            parts = lambda d: {k: d.getField(k) for k in ("month", "day")}
            return let(date, lambda d: _let_all(stamp, year=_full_year(d.getField("year")), **parts(d), clock=_clock(g, 3)))

        return _matched(clean, pattern, 12, read)

    def number(digits: Column) -> Column:
        return F.coalesce(_number(digits), F.lit(1))

    def date(year: Column, month: Column, day: Column) -> Column:
        return F.struct(year.alias("year"), month.alias("month"), day.alias("day"))

    def alone(a: Column, b: Column, c: Column) -> Column:
        return _let_all(
            lambda x, y, z: F.when(x.between(1, LAST_DAY), date(z, x, y)).otherwise(date(x, y, z)),
            x=number(a), y=number(b), z=number(c),
        )

    def beside(name: Column, a: Column, b: Column) -> Column:
        return _let_all(
            lambda x, y, month: F.when(x.between(1, LAST_DAY), date(y, month, x)).otherwise(date(x, month, y)),
            x=number(a), y=number(b), month=F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name),
        )

    forms = ((NUMBERS, alone), (NAME_FIRST, beside), (NUMBER_FIRST, lambda a, name, b: beside(name, a, b)))
    clean = F.trim(F.regexp_replace(F.lower(raw), r"\([^()]*\)", " "))
    clean = F.regexp_replace(clean, WORDS, "")
    return let(clean, lambda c: F.coalesce(*[dated(c, pattern, order) for pattern, order in forms]))


def js_timestamp(raw: Column) -> Column:
    """SCA2: the time that the pages read from a text; null where they read none."""
    return let(raw, lambda r: F.coalesce(iso_timestamp(r), free_timestamp(r)))
