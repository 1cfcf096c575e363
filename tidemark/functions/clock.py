"""Time: event stamps on the executors, window bounds on the driver."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def utc(text: Column) -> Column:
    """ISO-8601 text with ``Z`` or an offset as a zone-free UTC timestamp, whatever the session zone.

    Text without an offset already is UTC.
    """
    zoned = text.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$") & (F.length(text) > 10)
    instant = F.convert_timezone(None, F.lit("UTC"), text.try_cast("timestamp"))
    return F.when(zoned, instant).otherwise(text.try_cast("timestamp_ntz"))


def window_bounds(start: str | dt.datetime, end: str | dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Both ends of a replay window as naive UTC. An end given as a bare date covers that whole day."""
    low, high = _instant(start), _instant(end)
    if isinstance(end, str) and len(end.strip()) == len("2024-01-01"):
        high += dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    if low > high:
        raise ValueError("Replay start must not be after replay end")
    return low, high


def _instant(moment: str | dt.datetime) -> dt.datetime:
    value = dt.datetime.fromisoformat(moment.strip()) if isinstance(moment, str) else moment
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def stamp(moment: dt.datetime) -> Column:
    """A driver-side moment as a literal, so that Catalyst can push the comparison to the scan."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
