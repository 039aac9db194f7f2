"""Time ranges of imported rows: thirteen ways to (start, end) in milliseconds, end exclusive.

Each function takes string columns and gives two columns; both null means that the row is rejected. A missing start or
end is taken from the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.time import DAY_MS, Granularity, after, align_down, ms_of, parse_date

Range = tuple[Column, Column]
Parsers = Sequence[Callable[[Column], Column]] | None  # for mappings of texts: what parses each column


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    """The first instant of a day; null for days that there are not."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    whole = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(whole, ms_of(text.try_cast("date")))


def _both(start: Column, end: Column) -> tuple[Column, Column]:
    return F.coalesce(start, end), F.coalesce(end, start)


def _valid_month(month: Column) -> Column:
    return F.when((month > 12) | (month <= 0), F.lit(1)).otherwise(month)


def year_numbers(start: Column, end: Column | None = None) -> Range:
    """whole years."""
    first, last = _both(_int(start), _int(end if end is not None else start))
    one = F.lit(1)
    return _day(first, one, one), _day(last + 1, one, one)


def year_texts(start: Column, end: Column | None = None, parse: Parsers = None) -> Range:
    """dates cut to years."""
    return _texts(start, end, Granularity.YEAR, parse)


def month_numbers(year: Column, month: Column, end_year: Column | None = None, end_month: Column | None = None) -> Range:
    """whole months; an impossible month is the first, and an impossible last one ends with the first."""
    y, m = _int(year), _valid_month(_int(month))
    if end_year is None:
        start = _day(y, m, F.lit(1))
        return start, after(start, Granularity.MONTH)
    y1, y2 = _both(y, _int(end_year))
    m1, m2 = _both(_int(month), _int(end_month))
    m1 = _valid_month(m1)
    last = F.when(m2 > 12, F.lit(1)).when(m2 <= 0, m1 + 1).otherwise(m2)
    # A start in December with an impossible end month ends with January of the next year.
    last_start = _day(F.when(last > 12, y2 + 1).otherwise(y2), F.when(last > 12, F.lit(1)).otherwise(last), F.lit(1))
    end = F.when(m2 <= 0, last_start).otherwise(after(last_start, Granularity.MONTH))
    return _day(y1, m1, F.lit(1)), end


def month_texts(start: Column, end: Column | None = None, parse: Parsers = None) -> Range:
    """F7, F8: dates cut to months."""
    return _texts(start, end, Granularity.MONTH, parse)


def day_numbers(year: Column, month: Column, day: Column, end_year: Column | None = None, end_month: Column | None = None, end_day: Column | None = None) -> Range:
    """days. From a start alone, an impossible day rejects the row; else the parts are mended.

    A bad start month or day is the first. An end with neither a good month nor a good day is the end of its year; with
    a bad month alone it is that day in December; with a bad day alone it is the end of its month.
    """
    if end_year is None:
        start = _day(_int(year), _int(month), _int(day))
        return start, start + DAY_MS
    y1, y2 = _both(_int(year), _int(end_year))
    m1, m2 = _both(_int(month), _int(end_month))
    d1, d2 = _both(_int(day), _int(end_day))
    one = F.lit(1)
    bad = lambda x, most: (x <= 0) | (x > most)
    start = _day(y1, F.when(bad(m1, 12), one).otherwise(m1), F.when(bad(d1, 31), one).otherwise(d1))
    by_month = _day(y2, m2, one)
    end = (
        F.when(bad(m2, 12) & bad(d2, 31), _day(y2 + 1, one, one))
        .when(bad(m2, 12), _day(y2, F.lit(12), d2) + DAY_MS)
        .when(bad(d2, 31), after(by_month, Granularity.MONTH))
        .otherwise(_day(y2, m2, d2) + DAY_MS)
    )
    return start, end


def day_texts(start: Column, end: Column | None = None, parse: Parsers = None) -> Range:
    """dates cut to days."""
    return _texts(start, end, Granularity.DAY, parse)


def range_texts(start: Column, end: Column, parse: Parsers = None) -> Range:
    """two dates, the end taken as it is."""
    dates = _dates([start, end], parse)
    return _both(dates[0], dates[1])


def _dates(texts: Sequence[Column], parse: Parsers) -> Column:
    """The texts' dates: by the form that fits each, or by the parser of each column."""
    return F.transform(F.array(*texts), parse_date) if parse is None else F.array(*(p(x) for p, x in zip(parse, texts)))


def _texts(start: Column, end: Column | None, unit: Granularity, parse: Parsers) -> Range:
    # Each date is parsed once, whatever uses it.
    dates = _dates([start] if end is None else [start, end], parse)
    first, last = (dates[0], dates[0]) if end is None else _both(dates[0], dates[1])
    parsed = F.array(F.struct(first.alias("first"), last.alias("last")))
    found = F.transform(parsed, lambda x: F.struct(align_down(x["first"], unit).alias("s"), after(x["last"], unit).alias("e")))[0]
    return found["s"], found["e"]


#: Mapping names of an import -> function.
MAPPINGS = {
    "year_numbers": year_numbers,
    "year_texts": year_texts,
    "month_numbers": month_numbers,
    "month_texts": month_texts,
    "day_numbers": day_numbers,
    "day_texts": day_texts,
    "range_texts": range_texts,
}
