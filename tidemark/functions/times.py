"""Timestamps without time zone: parsing, shifting and whole-second positions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """Timestamp of a string, null where it does not parse."""
    return text.try_cast("timestamp_ntz")


def seconds(n: int) -> Column:
    """Interval literal of ``n`` whole seconds."""
    return F.expr(f"INTERVAL '{int(n)}' SECOND")


def hours_to_seconds(hours: float) -> int:
    """Fractional hours become whole minutes first, as the window widths are defined."""
    return int(round(hours * 60)) * 60


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 (rounded down), free of the session time zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
