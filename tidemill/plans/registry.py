"""Names, query functions and oracle SQL of the workflow operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.functions import values  # noqa: F401  registers its queries
from tidemill.operators import analytics, commands, invariants, ledger, reads  # noqa: F401
from tidemill.plans import dataflow, graph  # noqa: F401
from tidemill.plans.catalog import CATALOG
from tidemill.sources.fixtures import Fixtures


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, build=q.build: build(Fixtures(spark, sf_dir))) for name, q in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle for name, q in CATALOG.items() if q.oracle}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["stuck"].build(Fixtures(spark, sf_dir))
