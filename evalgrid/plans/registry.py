"""Name -> (Spark builder, ANSI SQL) of every registered query."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ["classification", "alignment", "sessions", "ranking", "text", "audit", "modelling", "live", "geometry", "files"]


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"evalgrid.plans.{m}")
    return REGISTRY
