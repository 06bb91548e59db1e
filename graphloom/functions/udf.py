"""Python functions as columns, made when they are first used: their types need a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import functions as F


def arrow_udf(f: Callable, kind: str) -> Callable:
    """A function of rows whose arguments travel in Arrow batches."""
    make = lru_cache(maxsize=1)(lambda: F.udf(f, kind, useArrow=True))
    return lambda *columns: make()(*columns)


def series_udf(kind: str) -> Callable:
    """A decorator for a function of pandas series."""

    def wrap(f: Callable) -> Callable:
        make = lru_cache(maxsize=1)(lambda: F.pandas_udf(f, kind))
        return lambda *columns: make()(*columns)

    return wrap
