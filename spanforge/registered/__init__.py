"""Registered queries: each applies an operator to engine tables and may have an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.drivermap import Tables, oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], views: str = "", sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(views, sql)
