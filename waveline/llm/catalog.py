"""Registration of the queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from waveline.llm.common import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Modules that register queries.
MODULES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    for module in MODULES:
        import_module(f"waveline.llm.{module}")
