"""Names of the queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import detection, records, safety, scoring  # noqa: F401  (they register their queries)
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["identifier_inventory"](spark, sf_dir)
