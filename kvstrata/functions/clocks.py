"""Two clocks: expiry times count gregorian seconds, last-modified dates unix seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: gregorian seconds at the unix epoch.
GREGORIAN_EPOCH = 62_167_219_200


def unix_seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp without time zone, whatever the session's time zone is."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def gregorian(unix: Column) -> Column:
    return unix + GREGORIAN_EPOCH
