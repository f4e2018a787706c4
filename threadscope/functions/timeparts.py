"""Calendar parts of a timestamp column (UTC session)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds given as a number or numeric text; anything else becomes null."""
    return F.timestamp_seconds(seconds.cast("string").try_cast("double"))


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
