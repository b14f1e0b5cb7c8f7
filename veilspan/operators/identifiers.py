"""Native detectors of the types that a shape and a check decide alone: no Python, whole-stage expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.layout import each, spread
from ..functions.vocabulary import SHAPES


def cards(text: str | Column) -> Column:
    return F.filter(X.spans(text, SHAPES["card"]), lambda x: X.luhn_ok(x.value))


def emails(text: str | Column) -> Column:
    return X.spans(text, SHAPES["email"])


def thai_ids(text: str | Column) -> Column:
    return F.filter(X.spans(text, SHAPES["thai_id"]), lambda x: X.thai_id_ok(x.value))


def ibans(text: str | Column) -> Column:
    return F.filter(X.spans(text, r"(?<![\p{L}\p{M}\p{N}_])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![\p{L}\p{M}\p{N}_])"), lambda x: X.iban_ok(x.value))


def phones(text: str | Column) -> Column:
    return _with_digits(text, F.concat(*[X.spans(text, SHAPES[s]) for s in ("mobile", "landline", "plus66")]))


def orphan_digits(text: str | Column) -> Column:
    return _with_digits(text, X.spans(text, r"(?<!\d)\d{6,}(?!\d)"))


def _with_digits(text: str | Column, found: Column) -> Column:
    """found, but nothing is looked for in a text without a digit."""
    none = F.array().cast("array<struct<s:int,e:int,value:string>>")
    return F.when((F.col(text) if isinstance(text, str) else text).rlike(r"(?U)\d"), found).otherwise(none)


NATIVE = {"THAI_ID": (thai_ids, "[0-9]"), "CREDIT_CARD": (cards, "[0-9]"), "IBAN": (ibans, "[A-Z]{2}[0-9]{2}"), "EMAIL": (emails, "@"), "PHONE": (phones, "[0-9]")}


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("data_type"), x.s.alias("s"), x.e.alias("e"), x.value.alias("value")))


def find(docs: DataFrame, kinds=("THAI_ID", "CREDIT_CARD", "IBAN", "EMAIL", "PHONE"), text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, data_type, s, e, value) of identifiers; a text without the character that a type needs skips its regex."""
    parts = []
    for k in kinds:
        fn, guard = NATIVE[k]
        hit = F.when(F.col(text_column).rlike(guard), fn(text_column))
        parts.append(_named(F.coalesce(hit, F.array().cast("array<struct<s:int,e:int,value:string>>")), k))
    any_guard = "|".join(dict.fromkeys(NATIVE[k][1] for k in kinds))
    return each(spread(docs).where(F.col(text_column).rlike(any_guard)), F.concat(*parts), id_column).select(id_column, "_x.*")


def inventory(found: DataFrame) -> DataFrame:
    """How many of each type, and how many distinct values."""
    value = X.canonical("data_type", "value")
    return found.groupBy("data_type").agg(F.count("*").alias("total"), F.countDistinct(value).alias("distinct_values"))
