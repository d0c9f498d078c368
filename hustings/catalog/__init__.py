"""Registered queries: what runs, which inventory rows it covers, and the SQL it must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    name: str
    covers: str
    run: Run
    sql: str | None


_QUERIES: dict[str, Query] = {}
MODULES = ("corpus", "texts", "stances", "matching", "matrices", "taxonomies", "positions", "evaluation")


def query(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        name = run.__name__
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = Query(name, covers, run, sql)
        return run

    return register


# Means of probabilities often end in a 5 just behind the digits that are compared, which one
# engine rounds up and another down. A nudge far above float noise takes both the same way.
NUDGE = "1.3e-11"


def rounded(c: Column | str, digits: int) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(float(NUDGE)), digits)


def query_of_means(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """A query whose values are ``rounded`` here and nudged the same way in its SQL."""
    return query(covers, sql and sql.replace("round(", f"round({NUDGE} + "))


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return dict(_QUERIES)
