"""Clocks: how a written moment becomes the instant a question is asked at."""

from datetime import date, datetime, time, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


class ClockError(ValueError):
    """Text given as a clock that is not a time."""


def instant(written=None):
    """A driver-side clock as a naive UTC datetime.

    A bare date means the whole of that day, so it becomes its last microsecond;
    nothing at all means now.
    """
    if written is None or (isinstance(written, str) and not written.strip()):
        return datetime.now(timezone.utc).replace(tzinfo=None)
    if isinstance(written, str):
        text = written.strip()
        try:
            moment = datetime.fromisoformat(text)
        except ValueError:
            raise ClockError(f"{written!r} is not a time, e.g. 2026-06-16 "
                             f"or 2026-06-16T00:00:00+00:00") from None
        if len(text) == 10:
            return datetime.combine(moment.date(), time.max)
        written = moment
    if isinstance(written, datetime):
        if written.tzinfo:
            written = written.astimezone(timezone.utc).replace(tzinfo=None)
        return written
    if isinstance(written, date):
        return datetime.combine(written, time.max)
    raise ClockError(f"{written!r} is not a time")


def instant_column(clock, dtype="timestamp_ntz"):
    """A clock as a Column of the log's own timestamp type (foldable, so it is
    pushed to the scan). Columns pass through."""
    if isinstance(clock, Column):
        return clock
    text = instant(clock).isoformat(sep=" ", timespec="microseconds")
    return F.lit(text).cast(dtype)


def end_of_day(col, dtype="timestamp_ntz"):
    """The column form: ten characters are a day and mean its last microsecond."""
    stamp = F.to_timestamp_ntz(col) if dtype == "timestamp_ntz" else F.to_timestamp(col)
    last = F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '0.000001' SECOND")
    return F.when(F.length(col) == 10, stamp + last).otherwise(stamp)
