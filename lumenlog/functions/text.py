"""Text classification, redaction and summarising as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.contracts import (
    ERROR_TEXT_PATTERNS,
    PII_HIGH,
    PII_KEYWORDS_HIGH,
    PII_KEYWORDS_LOW,
    PII_KEYWORDS_MODERATE,
    PII_LOW,
    PII_MODERATE,
    REDACTIONS,
    SUMMARY_CAP,
)
from lumenlog.functions.columns import cap, col, extract


def _any_of(patterns: list[str]) -> str:
    """One alternation; word boundaries and character classes follow Unicode."""
    return "(?U)(?:" + "|".join(patterns) + ")"


def _holds(text: Column, *literals: str) -> Column:
    found = F.lit(False)
    for literal in literals:
        found = found | text.contains(literal)
    return found


def redact(text: str | Column) -> Column:
    """Personal data and secrets replaced by ``<KIND_REDACTED>``."""
    out = col(text)
    for kind, pattern in REDACTIONS.items():
        out = F.regexp_replace(out, pattern, f"<{kind}_REDACTED>")
    return out


def redact_value(value: Column, data_type: T.DataType) -> Column:
    """``redact`` on every string inside a nested value; other leaves are kept."""
    if isinstance(data_type, T.StringType):
        return redact(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, v: redact_value(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = [redact_value(value.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def pii_risk(text: Column) -> Column:
    """Risk tier of a text: the first tier any of whose patterns matches, in any case.

    A pattern is tried only on texts that hold the literal every match must contain; the literal search is far cheaper.
    """
    low = F.lower(text)
    email, *numbers, ssn = PII_MODERATE
    high = _holds(low, "password", "secret", "key", "token", "authorization") & low.rlike(_any_of(PII_HIGH))
    moderate = (
        (low.contains("@") & low.rlike(_any_of([email]))) | low.rlike(_any_of(numbers)) | (low.contains("ssn") & low.rlike(_any_of([ssn])))
    )
    identifiers = low.contains("id") & _holds(low, "user", "account", "customer") & low.rlike(_any_of(PII_LOW))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "none").when(high, "high").when(moderate, "moderate").when(identifiers, "low").otherwise("none")
    )


def pii_risk_keywords(message: str | Column, json_payload: str | Column) -> Column:
    """The envelope view's broader keyword tiers."""
    text = F.concat(F.coalesce(col(message), F.lit("")), F.coalesce(col(json_payload), F.lit("")))
    return (
        F.when(text.rlike(PII_KEYWORDS_HIGH), "high")
        .when(text.rlike(PII_KEYWORDS_MODERATE), "moderate")
        .when(text.rlike(PII_KEYWORDS_LOW), "low")
        .otherwise("none")
    )


def error_in_text(text: str | Column, limit: int | None = None) -> Column:
    """What follows the first error word of a text, patterns tried in order; whole unless a limit is given."""
    return cap(F.coalesce(*[extract(text, p) for p in ERROR_TEXT_PATTERNS]), limit, "")


def stack_trace(text: str | Column, limit: int | None = None) -> Column:
    text = col(text)
    return F.when(text.contains("Traceback") | text.contains("at "), cap(text, limit, ""))


def summary(text: str | Column) -> Column:
    return F.when(F.coalesce(col(text), F.lit("")) != "", cap(text, SUMMARY_CAP))
