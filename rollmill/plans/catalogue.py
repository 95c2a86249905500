"""Every query of the core, by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollmill.plans import groups, records, selection, shapes, texts, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for _module in (selection, groups, tokens, texts, shapes, records):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
