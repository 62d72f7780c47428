"""Run-log text: durations and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_TIME = "dd/MM/yyyy HH:mm:ss"


def duration_text(seconds: Column) -> Column:
    """Whole seconds as `1h 2m 3s`."""
    s = seconds.cast("bigint")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def duration_seconds(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, r"^(\d+)h (\d+)m (\d+)s$", i).cast("bigint")
    return part(1) * 3600 + part(2) * 60 + part(3)


def log_time(text: Column) -> Column:
    return F.to_timestamp(text, LOG_TIME)


def log_time_text(ts: Column) -> Column:
    return F.date_format(ts, LOG_TIME)
