"""Column functions on moments.  All timestamps are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(n: float) -> Column:
    """A day-time interval of ``n`` seconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)"))


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(int(n)), F.lit(0), F.lit(0))


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(int(n)), F.lit(0), F.lit(0), F.lit(0))


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from ``a`` to ``b``."""
    return F.timestamp_diff("MICROSECOND", a, b)


def midnight(c: Column) -> Column:
    return F.date_trunc("day", c).cast("timestamp_ntz")


def label_bucket(c: Column) -> Column:
    """The midnight whose following day, its own end included, holds ``c``."""
    return midnight(c - F.expr("INTERVAL 0.000001 SECOND"))


def snapshot_bucket(c: Column) -> Column:
    """The midnight whose day of history holds ``c``: an event at midnight belongs to that midnight."""
    return label_bucket(c) + F.expr("INTERVAL 1 DAY")


def age_hours(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(3.6e9)


def age_days(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(8.64e10)


def day_number(c: Column) -> Column:
    """Days since 1970, for RANGE frames."""
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def micros(c: Column) -> Column:
    """Microseconds since 1970, for RANGE frames."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def moment(c: Column) -> Column:
    """The moment of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def local_to_utc(c: Column, zone: str, ambiguous: str = "reject") -> Column:
    """UTC of a local moment without zone; null where the clock skipped it or, with ``reject``, showed it twice."""
    if zone == "UTC":
        return c.cast("timestamp_ntz")
    utc = F.to_utc_timestamp(c.cast("timestamp"), zone)
    back = lambda u: F.from_utc_timestamp(u, zone)
    local = c.cast("timestamp")
    fine = back(utc) == local
    if ambiguous == "reject":
        fine &= (back(utc + F.expr("INTERVAL 1 HOUR")) != local) & (back(utc - F.expr("INTERVAL 1 HOUR")) != local)
    return F.when(fine, utc).cast("timestamp_ntz")


def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)
