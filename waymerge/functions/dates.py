"""UTC day and minute keys and safe timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'_'HH-mm")


def iso(ts: Column) -> Column:
    """ISO instant with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def safe_iso(text: Column) -> Column:
    """ISO instant of a timestamp or its text; the epoch when it does not parse."""
    return F.coalesce(iso(text.try_cast("timestamp")), F.lit("1970-01-01T00:00:00.000Z"))


def seconds_to_next_day(ts: Column) -> Column:
    """Seconds to the next midnight, rounded up, at least 60."""
    into_day = (
        F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    )
    return F.greatest(F.ceil(F.lit(86400.0) - into_day), F.lit(60)).cast("int")
