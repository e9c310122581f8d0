"""Named queries with the SQL that must give the same rows.

A query module registers with ``@query(name, sql)``; the SQL is written on its own, for another engine, from the definition.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("retrieval", "lexical", "judging", "dialogues", "history", "control", "textual", "streams", "learned", "hybrid", "episodes")


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _m in MODULES:
    importlib.import_module(f"priorweave.plans.{_m}")
