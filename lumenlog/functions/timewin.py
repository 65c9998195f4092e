"""Look-back windows relative to an explicit moment."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.columns import literal_like

EVENTS_AS_OF = "2024-01-31 00:00:00"
BILLING_AS_OF = "2001-11-05"


def parse(moment: str) -> datetime:
    return datetime.fromisoformat(moment)


def shift(moment: str, **delta: float) -> str:
    """``moment`` moved by a timedelta, as text."""
    return (parse(moment) + timedelta(**delta)).isoformat(sep=" ")


def since(df: DataFrame, column: str, as_of: str, **back: float) -> Column:
    """column >= as_of - back"""
    return F.col(column) >= literal_like(df, column, shift(as_of, **{k: -v for k, v in back.items()}))


def within(df: DataFrame, as_of: str, hours: float, ts: str = "event_timestamp", date: str | None = "log_date") -> Column:
    """The look-back window on the timestamp plus the day range it implies on the partition column.

    The day range prunes partitions; the timestamp bound is exact.
    """
    start = shift(as_of, hours=-hours)
    predicate = F.col(ts) >= literal_like(df, ts, start)
    if date and date in df.columns:
        days = (F.to_date(F.lit(start[:10])), F.to_date(F.lit(as_of[:10])))
        predicate = F.col(date).between(*days) & predicate
    return predicate


def between(df: DataFrame, as_of: str, hours: float, ts: str = "event_timestamp", date: str | None = "log_date") -> Column:
    """Like ``within`` but also bounded above by ``as_of``."""
    return within(df, as_of, hours, ts, date) & (F.col(ts) <= literal_like(df, ts, as_of))


def days_back(column: str, as_of: str, days: int) -> Column:
    """date column >= as_of - days"""
    return F.col(column) >= F.date_sub(F.to_date(F.lit(as_of[:10])), days)


def day(as_of: str) -> Column:
    return F.to_date(F.lit(as_of[:10]))


def week_start(date: Column) -> Column:
    """Sunday on or before ``date``."""
    return F.date_sub(F.date_trunc("WEEK", F.date_add(date, 1)).cast("date"), 1)


def month_start(date: Column) -> Column:
    return F.date_trunc("MONTH", date).cast("date")
