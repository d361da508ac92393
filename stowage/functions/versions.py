"""Version strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import col


def parts(version: Column | str) -> Column:
    """Numeric dot parts; parts that are no number are dropped."""
    return F.transform(F.filter(F.split(col(version), "\\."), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("bigint"))


def newer(a: Column | str, b: Column | str) -> Column:
    """Whether ``a`` is greater: parts compared in order, a longer one wins a tie."""
    return parts(a) > parts(b)


def prerelease(version: Column | str) -> Column:
    return col(version).rlike("-|alpha|beta|rc")


def without_v(tag: Column | str) -> Column:
    return F.regexp_replace(col(tag), "^v", "")
