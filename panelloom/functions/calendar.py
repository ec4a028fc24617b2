"""Month arithmetic.

The engine keys months by ``mi = year * 12 + month - 1`` so that "n months back" is
plain integer arithmetic and a range of months is a ``BETWEEN`` that reaches the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(date: Column | str) -> Column:
    d = _col(date)
    return F.year(d) * 12 + F.month(d) - 1


def year_of(mi: Column | str) -> Column:
    return F.floor(_col(mi) / 12).cast("int")


def month_of(mi: Column | str) -> Column:
    return (F.pmod(_col(mi), F.lit(12)) + 1).cast("int")


def ym_of_date(date: Column | str) -> Column:
    d = _col(date)
    return F.year(d) * 100 + F.month(d)


def ym_of_index(mi: Column | str) -> Column:
    return year_of(mi) * 100 + month_of(mi)


def index_of_ym(ym: Column | str) -> Column:
    c = _col(ym)
    return (F.floor(c / 100) * 12 + c % 100 - 1).cast("int")


def shift_ym(ym: Column | str, months: int) -> Column:
    """``ym`` moved by a number of months (negative = back)."""
    return ym_of_index(index_of_ym(ym) + F.lit(months))


def month_start(mi: Column | str) -> Column:
    return F.make_date(year_of(mi), month_of(mi), F.lit(1))


def month_end(mi: Column | str) -> Column:
    return F.last_day(month_start(mi))


def first_of_ym(ym: Column | str) -> Column:
    return month_start(index_of_ym(ym))


def load_start(date: Column | str, lookback: int = 12) -> Column:
    """First day of the month that lies ``lookback + 1`` months before ``date``."""
    return F.add_months(F.trunc(_col(date), "MM"), -(lookback + 1))


def month_label(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def lenient_date(text: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """Text to date; anything that does not parse becomes NULL."""
    return F.try_to_timestamp(_col(text), F.lit(pattern)).cast("date")


def date_in_path(path: Column | str) -> Column:
    """Date taken from a ``YYYYMMDD.csv`` component of a path; NULL if there is none."""
    digits = F.regexp_extract(_col(path), r"(?:^|[/=])(\d{8})\.csv(?:/|$)", 1)
    return lenient_date(F.when(digits != "", digits), "yyyyMMdd")


def window_label(train_end: Column | str) -> Column:
    return F.concat(F.lit("window_"), F.date_format(_col(train_end), "yyyyMM"))


def is_fitting_month(mi: Column | str) -> Column:
    """Even month of an even year, or odd month of an odd year."""
    return year_of(mi) % 2 == month_of(mi) % 2


def period_index(period: str) -> int:
    """'YYYY-MM' (a longer ISO date is accepted) to a month index, on the driver."""
    year, month = period.strip().split("-")[:2]
    if not 1 <= int(month) <= 12:
        raise ValueError(f"not a month: {period!r}")
    return int(year) * 12 + int(month) - 1


def in_period(mi: Column | str, start: str, end: str) -> Column:
    lo, hi = period_index(start), period_index(end)
    if lo > hi:
        raise ValueError(f"period starts after it ends: {start} > {end}")
    return _col(mi).between(lo, hi)


def in_any_period(mi: Column | str, periods) -> Column:
    out = F.lit(False)
    for start, end in periods:
        out = out | in_period(mi, start, end)
    return out


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value.strip()[:10])
