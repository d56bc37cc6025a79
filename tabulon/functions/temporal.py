"""Date and time functions of ``Series.dt``, as Column -> Column. Parts are longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(f):
    return lambda c: f(c).cast("long")


def _month_end(c: Column) -> Column:
    return F.to_date(c) == F.last_day(c)


def _start(c: Column, unit: str) -> Column:
    return F.to_date(c) == F.to_date(F.date_trunc(unit, c.cast("timestamp")))


def leap(c: Column) -> Column:
    y = F.year(c)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


#: Steps of rounding, in microseconds.
UNITS = {"D": 86_400_000_000, "H": 3_600_000_000, "h": 3_600_000_000, "T": 60_000_000, "min": 60_000_000, "S": 1_000_000, "s": 1_000_000, "L": 1_000, "ms": 1_000, "U": 1, "us": 1}


def _step(freq: str) -> int:
    digits = "".join(x for x in freq if x.isdigit())
    return int(digits or 1) * UNITS[freq[len(digits) :]]


def rounded(c: Column, freq: str, how: str) -> Column:
    """Floor, ceil or round (half to even) to a fixed frequency."""
    step, us = _step(freq), F.unix_micros(c.cast("timestamp"))
    low = F.floor(us / step) if step < 2 else (us - F.pmod(us, F.lit(step))) / step
    low, rest = low.cast("long"), F.pmod(us, F.lit(step))
    up = {"floor": F.lit(0), "ceil": (rest > 0).cast("long"), "round": F.when(rest * 2 > step, 1).when(rest * 2 < step, 0).otherwise(F.pmod(low, F.lit(2)))}[how]
    return F.timestamp_micros(((low + up) * step).cast("long"))


#: strftime codes as Spark's patterns.
_CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%B": "MMMM", "%b": "MMM", "%d": "dd", "%A": "EEEE", "%a": "EEE", "%H": "HH", "%I": "hh", "%p": "a", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%%": "'%'"}


def strftime(c: Column, date_format: str) -> Column:
    out, i, text = "", 0, ""
    while i < len(date_format):
        code = date_format[i : i + 2]
        if code in _CODES:
            out, text, i = out + (f"'{text}'" if text else "") + _CODES[code], "", i + 2
        else:
            text, i = text + date_format[i].replace("'", "''"), i + 1
    return F.date_format(c, out + (f"'{text}'" if text else ""))


PROPERTIES = {
    "date": F.to_date, "year": _long(F.year), "month": _long(F.month), "day": _long(F.dayofmonth), "hour": _long(F.hour), "minute": _long(F.minute), "second": _long(F.second),
    "microsecond": lambda c: F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000)).cast("long"), "week": _long(F.weekofyear), "weekofyear": _long(F.weekofyear),
    "dayofweek": _long(F.weekday), "day_of_week": _long(F.weekday), "weekday": _long(F.weekday), "dayofyear": _long(F.dayofyear), "day_of_year": _long(F.dayofyear), "quarter": _long(F.quarter),
    "is_month_start": lambda c: F.dayofmonth(c) == 1, "is_month_end": _month_end, "is_quarter_start": lambda c: _start(c, "quarter"), "is_quarter_end": lambda c: _month_end(c) & (F.month(c) % 3 == 0),
    "is_year_start": lambda c: _start(c, "year"), "is_year_end": lambda c: _month_end(c) & (F.month(c) == 12), "is_leap_year": leap,
    "daysinmonth": lambda c: F.dayofmonth(F.last_day(c)).cast("long"), "days_in_month": lambda c: F.dayofmonth(F.last_day(c)).cast("long"),
}

METHODS = {
    "normalize": lambda c: F.date_trunc("day", c.cast("timestamp")), "strftime": strftime, "month_name": lambda c: F.date_format(c, "MMMM"), "day_name": lambda c: F.date_format(c, "EEEE"),
    "round": lambda c, freq: rounded(c, freq, "round"), "floor": lambda c, freq: rounded(c, freq, "floor"), "ceil": lambda c, freq: rounded(c, freq, "ceil"),
}
