"""Registered queries: each builds a DataFrame from the given tables and, where SQL can express
it, carries the same result as ANSI SQL."""

from evalgrid.plans.registry import REGISTRY, Query, load_all

__all__ = ["REGISTRY", "Query", "load_all"]
