"""SQL text over named DataFrames with bound parameters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """Rows of a query. ``:name`` markers are bound, never pasted; ``{table}`` names the given DataFrames."""
    return spark.sql(text, args=dict(args or {}), **tables)
