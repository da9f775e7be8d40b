"""Dates: periods, anniversaries, formats and durations. "Today" is always a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import blank_to_null, col, js_round, source_number


def period_end(start: Column | str, months: int | Column) -> Column:
    """The last day of a period of whole months."""
    return F.date_sub(F.add_months(col(start), months), 1)


def day_first(x: Column | str) -> Column:
    return F.coalesce(F.date_format(col(x), "dd/MM/yyyy"), F.lit(""))


def periods_in(x: Column | str) -> Column:
    """All dd-mm-yyyy dates of a text."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(r"(\d{2}-\d{2}-\d{4})"), F.lit(1)), lambda d: F.try_to_date(d, "dd-MM-yyyy"))


def period_start(x: Column | str) -> Column:
    return F.get(periods_in(x), F.lit(0))


def anniversary(anchor: Column | str, invoiced: Column | str, ahead: int = 60, years: int = 2) -> Column:
    """The anchor's last anniversary that isn't more than some days after the invoice; the invoice's date where there is none."""
    anchor, invoiced = col(anchor), col(invoiced)
    limit = F.date_add(invoiced, ahead)
    first = lambda back: F.make_date(F.year(limit) - back, F.month(anchor), F.lit(1))
    of_year = lambda back: F.least(F.date_add(first(back), F.dayofmonth(anchor) - 1), F.last_day(first(back)))
    found = F.array_max(F.filter(F.transform(F.sequence(F.lit(0), F.lit(years)), of_year), lambda d: d <= limit))
    return F.when(invoiced.isNotNull(), F.coalesce(found, invoiced))


def cleaned(x: Column | str, *placeholders: str) -> Column:
    """A written date (yyyy-mm-dd and whatever follows) as it stands; placeholders, zero dates and years before 1900 are null.

    Days up to 31 are taken in every month, so that a wrong day is still seen; ``cleaned_date`` has dates only.
    """
    part = lambda k: F.regexp_extract(col(x), r"^(\d{4})-(\d{2})-(\d{2})", k).try_cast("int")
    good = (part(1) >= 1900) & part(2).between(1, 12) & part(3).between(1, 31)
    return F.when(good & ~col(x).isin(*placeholders) if placeholders else good, col(x))


def cleaned_date(x: Column | str, *placeholders: str) -> Column:
    """The same as a date; null for days that the month doesn't have."""
    return F.try_to_date(F.substring(cleaned(x, *placeholders), 1, 10))


def plausible(x: Column | str, least: str = "1900-01-01") -> Column:
    return F.when(col(x) >= F.lit(least).cast("date"), col(x))


def age_hours(since: Column | str, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(col(since))) / 3.6e9


def visited_on(x: Column | str, now: Column) -> Column:
    """A written date that isn't later than a day from now."""
    date = F.when(col(x).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col(x)))
    return F.when(date.cast("timestamp") <= now + F.expr("INTERVAL 24 HOURS"), date)


def fresh(sent: Column | str, now: Column, hours: int = 24) -> Column:
    """Whether a token is still valid."""
    return F.coalesce(col(sent) + F.make_interval(hours=F.lit(hours)) >= now, F.lit(False))


def year_month(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year.cast("int"), month.cast("int"))


# Units of time, in minutes.
UNITS = {"u": 60, "uur": 60, "uren": 60, "h": 60, "min": 1, "mins": 1, "minuten": 1, "minute": 1, "m": 1}
#: Bare numbers up to this are hours.
MOST_HOURS = 12


def duration_minutes(x: Column | str) -> Column:
    """Minutes of a written duration: a clock ("1:30", "2u30"), numbers with units ("1,5 uur 20 min"; the first of hours and of minutes count), or a bare number."""
    raw = F.lower(blank_to_null(x))
    clock = F.transform(F.split(F.regexp_extract(raw, r"^(\d{1,2}[:u]\d{1,2})$", 1), "[:u]"), lambda n: n.try_cast("double"))
    written = rf"(\d+(?:[.,]\d+)?)\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})\b"
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(written), F.lit(1)).alias("n"), F.regexp_extract_all(raw, F.lit(written), F.lit(2)).alias("unit"))

    def first(minutes: int, number: Callable[[Column], Column]) -> Column:
        own = F.filter(pairs, lambda p: p["unit"].isin(*[u for u, m in UNITS.items() if m == minutes]))
        return F.get(F.transform(own, lambda p: number(p["n"]).cast("double") * minutes), F.lit(0))

    hours = first(60, lambda n: F.translate(n, ",", "."))
    minutes = first(1, lambda n: F.regexp_extract(n, r"(\d+)$", 1))  # minutes are whole: of "2,5" only the 5
    bare = source_number(raw)
    zero = F.lit(0.0)
    return F.coalesce(
        F.when(F.size(clock) == 2, clock[0] * 60 + F.get(clock, F.lit(1))),
        F.when(F.size(pairs) > 0, js_round(F.coalesce(hours, zero) + F.coalesce(minutes, zero))),
        js_round(F.when(bare <= MOST_HOURS, bare * 60).otherwise(bare)),
    ).cast("long")
