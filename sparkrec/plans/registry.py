"""Registry of named queries: a Spark builder and, where SQL can express it,
an equivalent DuckDB oracle computed from the raw tables."""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


_CALL: contextvars.ContextVar = contextvars.ContextVar("sparkrec_query_call", default=None)


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def wrapped(spark, d):
            from ..session import ship_package

            ship_package(spark)
            token = _CALL.set({})
            try:
                return fn(spark, d)
            finally:
                _CALL.reset(token)

        QUERIES[name] = wrapped
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def stage(key, build):
    """A pipeline stage shared by several branches of one query: built (and
    usually materialised) once per query call, like the reference's stage
    files. Outside a query call it is simply built."""
    memo = _CALL.get()
    if memo is None:
        return build()
    if key not in memo:
        memo[key] = build()
    return memo[key]


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import (  # noqa: F401
        q_bridge,
        q_more,
        q_rank,
        q_seq,
        q_state,
        q_text,
        q_vectors,
    )
