"""Zone-free time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bucket_start(ts: Column, width: str) -> Column:
    """Start of the tumbling bucket of ``width`` (for example ``"10 minutes"``) holding ``ts``."""
    return F.window(ts, width).start


def interval_seconds(span: Column) -> Column:
    """Day-time interval in seconds, with the sign and the fraction kept."""
    parts = [("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1)]
    terms = [F.extract(F.lit(name), span).cast("decimal(24,6)") * weight for name, weight in parts]
    return sum(terms[1:], terms[0]).cast("decimal(24,6)")


def seconds_between(start: Column, end: Column) -> Column:
    return interval_seconds(end - start)


def days(count: float) -> Column:
    """Day-time interval of ``count`` days; fractions as in ``0.16``."""
    seconds = round(count * 86400, 6)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def ntz(moment: str | Column) -> Column:
    """Timestamp without zone from text or a column."""
    return (F.lit(moment) if isinstance(moment, str) else moment).cast("timestamp_ntz")


def minute_label(ts: Column) -> Column:
    """Display label of a snapshot time. It has no year, so keep ``ts`` as the sort key."""
    return F.date_format(ts, "MM-dd HH:mm")
