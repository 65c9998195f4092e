"""All registered queries; importing a plan module registers its queries."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import lumenlog.plans as plans
from lumenlog.adapters import with_adapters
from lumenlog.plans.registry import ORACLES, PLANS, runner

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module.endswith("_queries"):
        importlib.import_module(f"lumenlog.plans.{_module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(name) for name in PLANS}


def oracle_sql() -> dict[str, str]:
    return {name: with_adapters(sql) for name, sql in ORACLES.items()}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner(name)(spark, sf_dir)
