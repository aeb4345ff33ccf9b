"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group of the blueprint, each with an independent DuckDB oracle
(SQL over the driver tables) where the result is SQL-expressible."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from . import (  # noqa: F401
        vault, mart, functions, features, explain, crm, crm_vault, quality, ml, boost, sources, streams,
    )
