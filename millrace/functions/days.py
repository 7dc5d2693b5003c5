"""Days as ``yyyymmdd`` integers and clock formats in a fixed zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The home zone and the clock layouts.
HOME_ZONE = "+08:00"
SECOND_LAYOUT = "yyyyMMddHHmmss"
DAY_START_LAYOUT = "yyyyMMdd'000000'"


def _parts(day: Column) -> tuple[Column, Column, Column]:
    return F.floor(day / 10000), F.floor(day / 100) % 100, day % 100


def date_to_int(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.day(date)).cast("int")


def int_to_date(day: Column) -> Column:
    """The date of a ``yyyymmdd`` integer; months and days out of range roll over."""
    year, month, dom = _parts(day)
    start = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, (month - 1).cast("int")), (dom - 1).cast("int"))


def check_day(day: Column) -> Column:
    """Whether the integer is a calendar day written with eight digits."""
    year, month, dom = _parts(day)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = (
        F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    )
    valid = day.between(10000101, 99991231) & month.between(1, 12) & dom.between(1, longest)
    return F.coalesce(valid, F.lit(False))


def previous_day(day: Column) -> Column:
    return date_to_int(F.date_sub(int_to_date(day), 1))


def n_days_before(clock: Column, days: int | Column, zone: str = HOME_ZONE) -> Column:
    """The day ``days`` before the clock, read in ``zone``."""
    return date_to_int(F.date_sub(F.from_utc_timestamp(clock, zone), days))


def home_clock(ts: Column, layout: str = SECOND_LAYOUT, zone: str = HOME_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), layout)


def day_start_clock(ts: Column, zone: str = HOME_ZONE) -> Column:
    """The clock layout whose time part is a literal ``000000``."""
    return home_clock(ts, DAY_START_LAYOUT, zone)


def unix_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)
