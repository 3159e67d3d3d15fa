"""Queries of the engine core, by name, over the Parquet tables of one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import records, reports, rules, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**records.QUERIES, **rules.QUERIES, **reports.QUERIES, **states.QUERIES}
SQL: dict[str, str] = {**records.SQL, **rules.SQL, **reports.SQL, **states.SQL}
