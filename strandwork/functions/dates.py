"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d", "M/d/yyyy", "MMMM yyyy"]
RANGE = r"\s*[–—]\s*|\s+to\s+|\s+-\s+"


def iso_day(text: Column) -> Column:
    """The day that a text begins with, in ISO form; null if there is none."""
    return F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def _free(text: Column) -> Column:
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]))


def first_day(raw: Column) -> Column:
    """The day of a loosely written date, of a range its first: ISO as is, then ranges, then the known forms; else null.

    The start of a range takes the month and year that it lacks from its end.
    """
    text = F.trim(raw)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), iso_day(text))
    sides = F.split(text, RANGE)
    day_range = text.rlike(r"\d\s*-\s*\d") & ~text.rlike(r"^\d{4}-\d{2}-\d{2}")
    left = F.when(F.size(sides) > 1, F.get(sides, F.lit(0))).when(day_range, F.regexp_extract(text, r"^(.*?\d)\s*-\s*\d", 1))
    right = F.when(F.size(sides) > 1, F.get(sides, F.lit(1))).when(day_range, F.regexp_extract(text, r"\d\s*-\s*(\d.*)$", 1))
    year = F.regexp_extract(right, r"(\d{4})", 1)
    with_year = F.when(left.rlike(r"\d{4}"), left).otherwise(F.concat_ws(", ", left, year))
    month = F.regexp_extract(right, "([A-Za-z]+)", 1)
    with_month = F.when(left.rlike("^[0-9]+$"), F.concat(month, F.lit(" "), left, F.lit(", "), year)).otherwise(with_year)
    return F.coalesce(iso, F.when(left.isNotNull(), _free(with_month)), _free(text))


def next_refill(cycle_start: Column, refill_day: Column) -> Column:
    """The refill day of the next month, or that month's last day; never a day of the month that the cycle starts in."""
    month = F.add_months(F.trunc(cycle_start, "MM"), 1)
    return F.make_date(F.year(month), F.month(month), F.least(refill_day, F.day(F.last_day(month))))


def rolled_cycle(cycle_start: Column, refill_day: Column, today: Column) -> Column:
    """Start of the cycle that ``today`` is in: refills are followed month by month until the next would be later."""
    months = F.greatest(F.lit(1), F.ceil(F.months_between(F.last_day(today), F.trunc(cycle_start, "MM"))).cast("int"))

    def refill(i: Column) -> Column:
        month = F.add_months(F.trunc(cycle_start, "MM"), i)
        return F.make_date(F.year(month), F.month(month), F.least(refill_day, F.day(F.last_day(month))))

    refills = F.filter(F.transform(F.sequence(F.lit(1), months), refill), lambda d: d <= today)
    return F.coalesce(F.array_max(refills), cycle_start)
