"""Registered queries of the privacy engine, each with the SQL it must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakframe.plans import detection, evaluation, rewriting

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = detection.QUERIES | rewriting.QUERIES | evaluation.QUERIES
ORACLE_SQL: dict[str, str] = detection.ORACLE_SQL | rewriting.ORACLE_SQL | evaluation.ORACLE_SQL
