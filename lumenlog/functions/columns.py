"""Small Column builders shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_present(*columns: str | Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns])


def json_field(json: str | Column, path: str) -> Column:
    """Scalar at ``path`` of a JSON text; null where the text is not JSON or lacks the field."""
    return F.get_json_object(col(json), f"$.{path}")


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def contains_any(text: str | Column, words: Iterable[str]) -> Column:
    """True where the text holds one of the words; one alternation, so the text is walked once."""
    return F.coalesce(col(text).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def cap(text: str | Column, limit: int | None, tail: str = "...") -> Column:
    """The text, cut at ``limit`` characters with ``tail`` appended when something was cut; whole without a limit."""
    text = col(text)
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))).otherwise(text)


def extract(text: str | Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null (not '') without a match."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def differs(a: str | Column, b: str | Column) -> Column:
    """IS DISTINCT FROM."""
    return ~col(a).eqNullSafe(col(b))


def severity_in(values: Iterable[str], column: str | Column = "severity") -> Column:
    return col(column).isin(list(values))


def literal_like(df: DataFrame, column: str, value: str) -> Column:
    """A literal of the column's own type, so the comparison stays on the raw column and can be pushed to the scan."""
    return F.lit(value).cast(df.schema[column].dataType)
