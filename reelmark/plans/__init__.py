"""The named queries of the library and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelmark.plans import catalogue, files, frames, jobs, lists, marks, numbering, pixels, scan, streams, texts

_MODULES = (frames, pixels, marks, scan, catalogue, jobs, texts, lists, numbering, files, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
