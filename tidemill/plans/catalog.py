"""Registration of queries: a name, a function from fixtures to a DataFrame, and its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemill.sources import fixtures
from tidemill.sources.fixtures import Fixtures


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def register(name: str, build: Callable[[Fixtures], DataFrame], oracle: str | None = None) -> None:
    """Adds a query; ``oracle`` may name fixture views as {view}."""
    if name in CATALOG:
        raise ValueError(f"query {name} is registered twice")
    CATALOG[name] = Query(name, build, fixtures.oracle(oracle) if oracle else None)


def query(name: str, oracle: str | None = None):
    """Decorator form of register."""

    def held(build: Callable[[Fixtures], DataFrame]):
        register(name, build, oracle)
        return build

    return held
