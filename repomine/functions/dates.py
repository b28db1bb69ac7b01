"""Time as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date cell of the report and the time stamp in its name.
DATE_TEXT = "EEE MMM dd HH:mm:ss zzz yyyy"
STAMP = "yyyyMMdd_HHmmss"


def java_date_text(time: Column) -> Column:
    """``Tue Jan 02 03:04:05 UTC 2024`` in the zone of the session."""
    return F.date_format(time, DATE_TEXT)


def stamp_text(time: Column) -> Column:
    return F.date_format(time, STAMP)
