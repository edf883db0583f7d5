"""All registered queries of the reference's operators, with the SQL that states the same results."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("curation", "text", "scoring", "calibration", "comparison", "resampling", "fusion", "audit", "wire", "state", "files", "gates", "studies", "checks", "matching", "storage", "contracts", "decided", "review", "archives")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its name, with its SQL for DuckDB if there is any."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"adjudica.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
