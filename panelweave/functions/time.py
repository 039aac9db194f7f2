"""Time as milliseconds since 1970-01-01 without a zone: alignment, units, pieces, display and date parsing.

All of it is column expressions on longs and dates, so no session time zone is involved.
"""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


class Granularity(Enum):
    NONE = 0
    SECOND = 10
    MINUTE = 20
    HOUR = 30
    DAY = 40
    WEEK = 50
    MONTH = 60
    QUARTER = 70
    YEAR = 80
    BIENNIAL = 90
    QUADRENNIAL = 100
    DECADE = 110
    CENTURY = 120
    MILLENNIUM = 130


_FIXED = {Granularity.SECOND: 1_000, Granularity.MINUTE: 60_000, Granularity.HOUR: 3_600_000, Granularity.DAY: DAY_MS}
_YEARS = {Granularity.YEAR: 1, Granularity.DECADE: 10, Granularity.CENTURY: 100, Granularity.MILLENNIUM: 1_000}


def date_of(ms: Column) -> Column:
    """The calendar day that holds the instant."""
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))


def ms_of(date: Column) -> Column:
    """The first instant of a day."""
    return F.unix_date(date).cast("long") * DAY_MS


def ms_of_timestamp(ts: Column) -> Column:
    """Milliseconds of a zone-free timestamp."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def align_down(ms: Column, unit: Granularity) -> Column:
    """The start of the unit that holds the instant."""
    if unit is Granularity.NONE:
        return ms
    if unit in _FIXED:
        return ms - F.pmod(ms, F.lit(_FIXED[unit]))
    if unit is Granularity.MONTH:
        return ms_of(F.trunc(date_of(ms), "MONTH"))
    if unit is Granularity.YEAR:
        return ms_of(F.trunc(date_of(ms), "YEAR"))
    if unit in _YEARS:
        many, year = _YEARS[unit], F.year(date_of(ms))
        return ms_of(F.make_date(year - F.pmod(year, F.lit(many)), F.lit(1), F.lit(1)))
    raise ValueError(f"{unit.name} has no alignment")


def after(ms: Column, unit: Granularity) -> Column:
    """The first unit boundary after the instant."""
    down = align_down(ms, unit)
    if unit in _FIXED:
        return down + _FIXED[unit]
    months = 1 if unit is Granularity.MONTH else 12 * _YEARS[unit]
    return ms_of(F.add_months(date_of(down), months))


def align_up(ms: Column, unit: Granularity) -> Column:
    """The instant itself on a boundary, else the next boundary."""
    down = align_down(ms, unit)
    return ms if unit is Granularity.NONE else F.when(down == ms, ms).otherwise(after(ms, unit))


def pieces(start: Column, end: Column, unit: Granularity) -> Column:
    """[start, end) as an array of struct(s, e), each within one unit; the first and last may be cropped."""
    if unit is Granularity.NONE:
        return F.array(F.struct(start.alias("s"), end.alias("e")))
    first = align_down(start, unit)
    if unit in _FIXED:
        marks = F.sequence(first, end - 1, F.lit(_FIXED[unit]).cast("long"))
        return F.transform(marks, lambda m: F.struct(F.greatest(m, start).alias("s"), F.least(m + _FIXED[unit], end).alias("e")))
    months = 1 if unit is Granularity.MONTH else 12 * _YEARS[unit]
    marks = F.sequence(date_of(first), date_of(end - 1), F.make_ym_interval(F.lit(months // 12), F.lit(months % 12)))
    return F.transform(marks, lambda d: F.struct(F.greatest(ms_of(d), start).alias("s"), F.least(ms_of(F.add_months(d, months)), end).alias("e")))


def units(start: Column, end: Column, unit: Granularity) -> Column:
    """How many units [start, end) touches; 1 without a unit."""
    return F.lit(1).cast("long") if unit is Granularity.NONE else F.size(pieces(start, end, unit)).cast("long")


def display(ms: Column) -> Column:
    """YYYY-Mon-DD."""
    return F.date_format(date_of(ms), "yyyy-MMM-dd")


def unit_label(ms: Column, unit: Granularity) -> Column:
    """A unit's name for messages: the year, month/year, or day."""
    pattern = {Granularity.YEAR: "yyyy", Granularity.MONTH: "M/yyyy"}.get(unit, "yyyy-MM-dd")
    return F.date_format(date_of(ms), pattern)


#: The date forms that imports accept, in order of preference.
DATE_FORMS = (
    "yyyy/M/d", "yyyy/M/d H:m:s", "yyyy\\M\\d", "yyyy\\M\\d H:m:s", "yyyy-M-d", "yyyy-M-d H:m:s",
    "M/d/yyyy", "M/d/yyyy H:m:s", "M\\d\\yyyy", "M\\d\\yyyy H:m:s", "M-d-yyyy", "M-d-yyyy H:m:s",
    "yyyyMMdd", "yyyyMMdd H:m:s",
    "MMM d, yyyy", "MMM d, yyyy H:m:s", "MMM d yyyy", "MMM d yyyy H:m:s", "MMM-d-yyyy", "MMM-d-yyyy H:m:s",
    "MMMM d, yyyy", "MMMM d, yyyy H:m:s", "MMMM d yyyy", "MMMM d yyyy H:m:s", "MMMM-d-yyyy", "MMMM-d-yyyy H:m:s",
    "yyyy/M", "yyyy\\M", "yyyy-M", "M/yyyy", "M\\yyyy", "M-yyyy", "yyyyMM",
    "MMM, yyyy", "MMM yyyy", "MMM-yyyy", "MMMM, yyyy", "MMMM yyyy", "MMMM-yyyy",
    "yyyy",
)


#: The same forms in fewer patterns (what is in brackets may be missing), each with the look of the texts that it takes.
_PATTERNS = (
    ("yyyy/M[/d[ H:m:s]]", r"[0-9]{4}/[0-9]"), ("yyyy\\M[\\d[ H:m:s]]", r"[0-9]{4}\\[0-9]"), ("yyyy-M[-d[ H:m:s]]", r"[0-9]{4}-[0-9]"),
    ("M/d/yyyy[ H:m:s]", r"[0-9]{1,2}/[0-9]{1,2}/"), ("M\\d\\yyyy[ H:m:s]", r"[0-9]{1,2}\\[0-9]{1,2}\\"), ("M-d-yyyy[ H:m:s]", r"[0-9]{1,2}-[0-9]{1,2}-"),
    ("yyyyMMdd[ H:m:s]", r"[0-9]{8}( |$)"), ("[MMMM][MMM] d[,] yyyy[ H:m:s]", r"[A-Za-z]+ [0-9]{1,2}[, ]"), ("[MMMM][MMM]-d-yyyy[ H:m:s]", r"[A-Za-z]+-[0-9]{1,2}-"),
    ("M/yyyy", r"[0-9]{1,2}/[0-9]{4}$"), ("M\\yyyy", r"[0-9]{1,2}\\[0-9]{4}$"), ("M-yyyy", r"[0-9]{1,2}-[0-9]{4}$"), ("yyyyMM", r"[0-9]{6}$"),
    ("[MMMM][MMM][,] yyyy", r"[A-Za-z]+,? [0-9]{4}$"), ("[MMMM][MMM]-yyyy", r"[A-Za-z]+-[0-9]{4}$"), ("yyyy", r"[0-9]{4}$"),
)


def parse_date(text: Column) -> Column:
    """Milliseconds of a date in one of ``DATE_FORMS``; null if none fits. The looks exclude each other, so one is tried."""
    text, found = F.trim(text), None
    for pattern, look in _PATTERNS:
        parsed = F.try_to_timestamp(text, F.lit(pattern.replace("\\", "'\\'"))).cast("timestamp_ntz")
        found = (F if found is None else found).when(text.rlike(f"^{look}"), parsed)
    return ms_of_timestamp(found)


def fits(text: Column) -> Column:
    """Which of ``DATE_FORMS`` a text fits, as bits of a long: bit i for form i."""
    text, mask = F.trim(text), F.lit(0).cast("long")
    for i, form in enumerate(DATE_FORMS):
        parsed = F.try_to_timestamp(text, F.lit(form.replace("\\", "'\\'")))
        # A form is only tried on texts that look like it.
        mask = mask.bitwiseOR(F.when(text.rlike(_look(form)) & parsed.isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def _look(form: str) -> str:
    """What texts of a form look like."""
    digits = {"yyyy": "[0-9]{4}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "MMM": "[A-Za-z]+", "MMMM": "[A-Za-z]+"}
    part = lambda found: digits.get(found[0], "[0-9]{1,2}" if found[0].isalpha() else re.escape(found[0]))
    return "^" + re.sub("yyyy|M+|dd|.", part, form) + "$"


def form_of(texts: DataFrame, column: str) -> str | None:
    """The date form of a column of texts: the one that most of them fit, the first of ``DATE_FORMS`` among equals.

    One pass: texts are counted by the set of forms that they fit, of which there are few. Null without a date.
    """
    counts = texts.select(fits(F.col(column)).alias("mask")).groupBy("mask").agg(F.count("*").alias("n")).collect()
    total = [sum(r["n"] for r in counts if r["mask"] >> i & 1) for i in range(len(DATE_FORMS))]
    return DATE_FORMS[total.index(max(total))] if max(total) else None


def parse_as(text: Column, form: str | None) -> Column:
    """Milliseconds of a date in one form; null where the text has another."""
    if form is None:
        return F.lit(None).cast("long")
    text = F.trim(text)
    return ms_of_timestamp(F.when(text.rlike(_look(form)), F.try_to_timestamp(text, F.lit(form.replace("\\", "'\\'"))).cast("timestamp_ntz")))
