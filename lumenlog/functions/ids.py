"""Deterministic identifiers derived from the content of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.functions.columns import col

DEFAULT_TRACE_PREFIX = "projects/p1/traces/"


def ts_text(ts: str | Column) -> Column:
    """A timestamp as text with its UTC offset."""
    return F.concat(col(ts).cast("string"), F.lit("+00"))


def minute_text(ts: str | Column) -> Column:
    return ts_text(F.date_trunc("MINUTE", col(ts)))


def blank(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


def synthetic_insert_id(*parts: Column) -> Column:
    """md5 of the parts; null where the first one (the timestamp) is."""
    return F.md5(F.concat(*parts))


def synthetic_trace_id(trace: str | Column, *key: Column, prefix: str = DEFAULT_TRACE_PREFIX) -> Column:
    """The given trace, else one trace per key (usually one service and minute)."""
    pieces: list[Column] = []
    for part in key:
        pieces += [part, F.lit("-")]
    return F.coalesce(col(trace), F.concat(F.lit(prefix), F.md5(F.concat(*pieces[:-1]))))


def synthetic_span_id(span: str | Column, *key: Column) -> Column:
    return F.coalesce(col(span), F.substring(F.md5(F.concat(*key)), 1, 16))


def natural_key(*parts: str | Column) -> Column:
    """sha-256 over the parts; nulls count as empty, a separator keeps neighbours apart."""
    return F.sha2(F.concat_ws("\u001f", *[blank(col(p).cast("string")) for p in parts]), 256)
