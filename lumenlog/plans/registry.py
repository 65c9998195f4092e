"""Registry of named queries: what Spark runs, and the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.adapters import Tables

Plan = Callable[[Tables], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name`` with its equivalent SQL (none where SQL cannot say it)."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    plan = PLANS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plan(Tables(spark, sf_dir))

    run.__name__ = name
    return run


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round half up through ``floor``: the same on every engine, unlike ``round`` on exact ties."""
    scale = float(10**digits)
    return df.withColumns({c: F.floor(F.col(c).cast("double") * scale + 0.5) / scale for c in columns})


def r(expr: str, digits: int = 4) -> str:
    """SQL text of ``rounded`` for the oracles."""
    scale = f"1e{digits}"
    return f"(floor(CAST(({expr}) AS DOUBLE) * {scale} + 0.5) / {scale})"
