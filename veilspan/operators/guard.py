"""Prompt-injection guard: rules as native spans; a finding is a category, a severity and a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocabulary import INJECTION


def _ranked(found: Column, rank: int, category: str, severity: str) -> Column:
    return F.transform(found, lambda x: F.struct(x.s.alias("s"), F.lit(rank).alias("rank"), x.e.alias("e"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), x.value.alias("value")))


def findings(text: str | Column) -> Column:
    """array<struct<s,e,category,severity,value>>, by start, ties in the order of the rules."""
    parts = []
    for rank, (category, severity, pattern) in enumerate(INJECTION):
        parts.append(_ranked(X.spans(text, pattern, ignore_case=True), rank, category, severity))
    return F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.category.alias("category"), x.severity.alias("severity"), x.value.alias("value")))


def guard(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with findings, and flags: distinct (category, severity) in the order they first appear."""
    d = docs.withColumn("findings", findings(F.coalesce(F.col(text_column), F.lit(""))))
    return d.withColumn("flags", F.array_distinct(F.transform("findings", lambda x: F.struct(x.category.alias("category"), x.severity.alias("severity")))))
