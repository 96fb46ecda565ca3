"""Queries by name with the SQL that their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosemill.plans import misc_queries, report_queries, rhythm_queries, structure_queries

_PARTS = (rhythm_queries, structure_queries, report_queries, misc_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _PARTS for k, v in m.ORACLES.items()}
