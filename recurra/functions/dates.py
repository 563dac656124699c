"""Dates as written, and UTC cut-off dates."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def literal_date(value: Column) -> Column:
    """The calendar date a string names, without shifting it to UTC; NULL if it names none.

    ISO forms with or without dashes and an optional time of day, to the end of the string.
    """
    s = F.trim(value)
    time = r"([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?([Zz]|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
    dashed, plain = F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}" + time)), F.regexp_like(s, F.lit(r"^\d{8}" + time))
    return (F.when(dashed, F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")))
            .when(plain, F.try_to_timestamp(F.substring(s, 1, 8), F.lit("yyyyMMdd")))).cast("date")


def cutoff_from_epoch(seconds: Column) -> Column:
    """UTC calendar date of an epoch (the session time zone is UTC)."""
    return F.to_date(F.timestamp_seconds(seconds))
