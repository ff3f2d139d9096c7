"""Column expressions on dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Holidays on a fixed date; the effect lasts until the day after.
HOLIDAYS = {"Tahun Baru": (1, 1), "Hari Kemerdekaan": (8, 17), "Hari Natal": (12, 25),
            "Hari Buruh": (5, 1), "Hari Pancasila": (6, 1)}
HOLIDAY_WINDOW_DAYS = 1


def cyclic(ts: Column) -> dict[str, Column]:
    """Sine and cosine of hour, weekday (Monday 0), day of year and month."""
    parts = {"hour": (F.hour(ts), 24), "dow": (F.weekday(ts), 7), "doy": (F.dayofyear(ts), 365.25),
             "month": (F.month(ts), 12)}
    out = {}
    for name, (value, period) in parts.items():
        out[f"{name}_sin"] = F.sin(2 * math.pi * value / period)
        out[f"{name}_cos"] = F.cos(2 * math.pi * value / period)
    return out


def composite_day(day: Column) -> Column:
    """First day of year of the 8-day composite."""
    return (F.floor((F.dayofyear(day) - 1) / 8) * 8 + 1).cast("int")


def fixed_dates(years: DataFrame, year: str) -> DataFrame:
    """(day, holiday, offset) for each year, with the days of the window after it."""
    listed = F.array(*[
        F.struct(F.date_add(F.make_date(year, F.lit(m), F.lit(d)), k).alias("day"),
                 F.lit(name).alias("holiday"), F.lit(k).alias("offset"))
        for name, (m, d) in HOLIDAYS.items() for k in range(HOLIDAY_WINDOW_DAYS + 1)])
    return years.select(F.inline(listed))
