"""Time expressions on wall-clock timestamps, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock(text: Column) -> Column:
    """The wall-clock time written in an ISO-8601 text; null if it is not one.

    The offset is dropped, not applied: 20:00:00+05:00 stays 20:00.
    """
    return text.try_cast("timestamp_ntz")


def instant(text: Column) -> Column:
    """The instant an ISO-8601 text stands for; null if it is not one."""
    return text.try_cast("timestamp")


def micros(wall: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of the same wall clock."""
    day = F.unix_date(wall.cast("date")).cast("bigint") * 86_400_000_000
    clock = F.hour(wall).cast("bigint") * 3_600_000_000 + F.minute(wall).cast("bigint") * 60_000_000
    seconds = (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("bigint")
    return day + clock + seconds


def is_off_hours(wall: Column) -> Column:
    """Before 09:00:00 or after 18:00:00, both strict to the microsecond."""
    past_the_hour = (F.minute(wall) > 0) | (F.extract(F.lit("SECOND"), wall) > 0)
    return (F.hour(wall) < 9) | (F.hour(wall) > 18) | ((F.hour(wall) == 18) & past_the_hour)


def is_weekend(wall: Column) -> Column:
    return F.weekday(wall) >= 5
