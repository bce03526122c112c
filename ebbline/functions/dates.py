"""Clock readings in UTC, whatever the session's time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_now() -> Column:
    """The current time as a UTC wall-clock reading, for formatting."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def utc_today() -> Column:
    return F.to_date(utc_now())
