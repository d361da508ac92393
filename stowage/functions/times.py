"""Integer time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import col


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.unix_seconds(col(ts).cast("timestamp"))
