"""Partial dates in free text: found, compared and moved.

A date is struct(sort_key, label, year, month, day) with sort_key = year * 10000 + month * 100 + day and 0 for parts
that are not known, so that ``2014`` and ``Sept 2014`` can be ordered among full dates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions import patterns as p
from rollcall.functions.text import bind, drop, squeeze, strip_source_number, trim, unwrap

LEADING, FULL, MONTH_YEAR, ISO, RANGE = p.LEADING_DATE, p.FULL_DATE, p.MONTH_YEAR, p.ISO_DATE, p.YEAR_RANGE


def split_leading_date(c: Column | str) -> Column:
    """struct(label, rest) of a text that starts with a date, else null."""
    return bind(trim(c), _split)


def _split(text: Column) -> Column:
    def parts(found: Column) -> Column:
        rest = trim(F.substring(text, F.length(found) + 1, F.length(text)))
        return F.when(found != "", F.struct(drop(found, r"[\s,.:;-]+$").alias("label"), rest.alias("rest")))

    return bind(F.regexp_extract(text, LEADING, 0), parts)


def _month(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in p.MONTHS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(c)), F.lit(0))


def _parts(label: Column) -> Column:
    """The date that a label is, or for a range starts with; null if its year isn't one of 19xx or 20xx without month."""
    part = lambda kind, i: F.regexp_extract(label, f"(?i)^{kind}$", i)
    date = lambda y, m, d: F.struct(*[x.cast("int").alias(n) for x, n in ((y, "year"), (m, "month"), (d, "day"))])
    zero = F.lit(0)
    year = F.regexp_extract(label, r"^(?:19|20)\d{2}", 0)
    found = (
        F.when(part(FULL, 0) != "", date(part(FULL, 3), _month(part(FULL, 1)), part(FULL, 2)))
        .when(part(MONTH_YEAR, 0) != "", date(part(MONTH_YEAR, 2), _month(part(MONTH_YEAR, 1)), zero))
        .when(part(ISO, 0) != "", date(part(ISO, 1), part(ISO, 2), part(ISO, 3)))
        .when(year != "", date(year, zero, zero)))
    return bind(found, lambda d: F.when(d.isNotNull(), F.struct(
        (d["year"] * 10000 + d["month"] * 100 + d["day"]).alias("sort_key"), trim(label).alias("label"), d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day"))))


def initial_date(c: Column | str) -> Column:
    """The date in front, and only that if there is one; else the first date of the most precise kind; else null.

    A four-digit number in front that is no year of 19xx or 20xx hides any later date.
    """
    # A kind is looked for only where its cheapest part is: a letter before a number, or a dash.
    month, dash = lambda text: text.rlike(r"[A-Za-z]\s+\d"), lambda text: text.contains("-")
    dashes = lambda text: text.rlike(p.DASH)
    inside = lambda text: F.coalesce(*[
        F.when(may(text), F.nullif(F.regexp_extract(text, f"(?i){p.LEFT}{kind}{p.RIGHT}", 0), F.lit("")))
        for kind, may in ((FULL, month), (ISO, dash), (MONTH_YEAR, month), (RANGE, dashes), (r"(?:19|20)\d{2}", lambda text: F.lit(True)))])
    label = lambda text: F.coalesce(_split(text)["label"], inside(text))
    text = strip_source_number(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return bind(bind(text, label), _parts)


def sort_key(c: Column | str) -> Column:
    return initial_date(c)["sort_key"]


def move_date_to_end(c: Column | str) -> Column:
    """``label rest`` as ``rest (label)``, unless it ends so already; a label alone stays."""

    def moved(text: Column, d: Column) -> Column:
        label, rest = d["label"], d["rest"]
        closed = F.concat(F.lit(r"(?i)\(\Q"), label, F.lit(r"\E\)\s*[.;]?$"))
        return (
            F.when(d.isNull(), text).when(rest == "", label).when(F.regexp_like(rest, closed), rest)
            .otherwise(F.concat(rest, F.lit(" ("), label, F.lit(")"))))

    return bind(trim(c), lambda text: bind(_split(text), lambda d: moved(text, d)))


def clean_record(c: Column | str) -> Column:
    return move_date_to_end(squeeze(strip_source_number(c)))


def clean_service(description: Column | str, dates: Column | str) -> Column:
    """struct(description, dates): number and date in front of the description removed; its date only where dates is blank."""
    given = F.coalesce(F.col(dates) if isinstance(dates, str) else dates, F.lit(""))

    def clean(text: Column) -> Column:
        return bind(_split(text), lambda lead: F.struct(
            F.coalesce(lead["rest"], text).alias("description"),
            unwrap(F.when(lead.isNotNull() & (given == ""), lead["label"]).otherwise(given)).alias("dates")))

    return bind(squeeze(strip_source_number(description)), clean)


def cutoff_key(cutoff: Column | str) -> Column:
    """The sort key of a cutoff such as 2020-01-01, null if it is malformed or has a part of 0."""
    c = F.lit(cutoff) if isinstance(cutoff, str) else cutoff
    y, m, d = (F.regexp_extract(c, rf"^{ISO}$", i).try_cast("int") for i in (1, 2, 3))
    return F.when((y > 0) & (m > 0) & (d > 0), y * 10000 + m * 100 + d)


def on_or_after(c: Column | str, cutoff: Column | str) -> Column:
    """False for a text without a date and for a malformed cutoff; a bare year is before any day of it."""
    return F.coalesce(sort_key(c) >= cutoff_key(cutoff), F.lit(False))


def before(c: Column | str, cutoff: Column | str) -> Column:
    return F.coalesce(sort_key(c) < cutoff_key(cutoff), F.lit(False))


def valid_iso_date(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c), F.lit(False))


def valid_since_year(c: Column | str, last: int) -> Column:
    """A whole number from 1950 to last."""
    n = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.coalesce((n == F.floor(n)) & n.between(1950, last), F.lit(False))


def year_span(c: Column | str) -> Column:
    """struct(first, last): the first and last year named; last is 9999 for a range left open, both null without a year."""
    c = F.col(c) if isinstance(c, str) else c
    years = F.transform(F.regexp_extract_all(c, F.lit(rf"{p.LEFT}((?:19|20)\d{{2}}){p.RIGHT}"), 1), lambda y: y.cast("int"))
    open_end = c.rlike(p.words("present", "current", "ongoing"))
    return F.struct(F.array_min(years).alias("first"), F.when(open_end, F.lit(9999)).otherwise(F.array_max(years)).alias("last"))


def active_since(c: Column | str, year: int) -> Column:
    """Dated in or reaching into the period; without a year, only if the text says that it is current."""
    return F.coalesce(year_span(c)["last"] >= year, F.lit(False))
