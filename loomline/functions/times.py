"""ISO timestamps with their quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONED = r"(Z|[+-]\d\d:?\d\d)$"


def instant(raw: Column) -> Column:
    """The instant of an ISO string with a zone; null for any other."""
    return F.when(raw.rlike(ZONED), F.try_to_timestamp(raw))


def quality(raw: Column) -> Column:
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "missing")
        .when(instant(raw).isNull(), "malformed-or-no-timezone")
        .otherwise("valid")
    )


def pacific_date(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, "America/Los_Angeles"))


def minutes_between(late: Column, early: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)) / F.lit(6e7)
