"""Numbers, times and rates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_number(col: Column) -> Column:
    """Text as a double; text that is no number becomes null."""
    return col.try_cast("double")


def try_time(col: Column) -> Column:
    """Text or time as a zone-less timestamp; text that is no time becomes null."""
    return col.try_cast("timestamp_ntz")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, truncated towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def run_stamp(ts: Column) -> Column:
    """Time stamp as it stands in run names."""
    return F.date_format(ts, "MM-dd-yy HHmm")


def run_name(emp_id: Column, ts: Column) -> Column:
    """Name of a run: employer id and time stamp."""
    return F.concat_ws(" ", emp_id.cast("string"), run_stamp(ts))


def created_on(ts: Column, day: Column) -> Column:
    """True where the time falls on the given day."""
    return F.coalesce(F.to_date(ts) == day, F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; null if there is no whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 1)
