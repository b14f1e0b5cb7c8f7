"""Receipts that can be checked again, the report on a breach with its failures, audit rows, and why a row failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import risk

SCHEMA = "receipt/1"
NEEDED = ("source.sha256", "source.bytes", "result.digest", "result.entity_count")
GRADES = "ABCDF"


def issue(docs: DataFrame, spans: str = "spans", text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, schema, fields): what is claimed of each document: hash and size of its bytes, digest and number of what was found."""
    d = risk.digest(docs, SCHEMA, spans, id_column).join(docs.select(id_column, F.col(text_column).cast("binary").alias("_b")), id_column)
    values = {"source.sha256": F.sha2("_b", 256), "source.bytes": F.octet_length("_b").cast("string"), "result.digest": F.col("digest"), "result.entity_count": F.col("entity_count").cast("string")}
    return d.select(id_column, F.lit(SCHEMA).alias("schema"), F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]).alias("fields"))


def verify(receipts: DataFrame, again: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, outcome, differences) of receipts against what is issued now (again, with an optional error where a text cannot be read).

    In this order: unsupported_schema, malformed_receipt (a field is missing), source_mismatch (another document), recompute_failed,
    result_mismatch (the same document, something else found), match. A document that is gone has no source.
    """
    now = again.select(id_column, F.col("fields").alias("_now"), (F.col("error") if "error" in again.columns else F.lit(None).cast("string")).alias("_error"))
    d = receipts.join(now, id_column, "left")
    need = F.array(*[F.lit(x) for x in NEEDED])
    lacks = F.filter(need, lambda k: ~F.coalesce(F.array_contains(F.map_keys("fields"), k), F.lit(False)))
    odd = F.filter(need, lambda k: ~F.element_at(F.col("fields"), k).eqNullSafe(F.element_at(F.col("_now"), k)))
    other = ~F.element_at(F.col("fields"), F.lit("source.sha256")).eqNullSafe(F.element_at(F.col("_now"), F.lit("source.sha256")))
    outcome = (
        F.when(~F.col("schema").eqNullSafe(F.lit(SCHEMA)), "unsupported_schema").when(F.col("fields").isNull() | (F.size(lacks) > 0), "malformed_receipt").when(F.col("_now").isNull() | other, "source_mismatch")
        .when(F.col("_error").isNotNull(), "recompute_failed").when(F.size(odd) > 0, "result_mismatch").otherwise("match")
    )
    d = d.withColumn("outcome", outcome)
    source = F.filter(odd, lambda k: k.startswith("source."))
    said = F.when(F.col("outcome") == "malformed_receipt", lacks).when(F.col("outcome") == "source_mismatch", source).when(F.col("outcome") == "result_mismatch", odd).otherwise(F.array().cast("array<string>"))
    return d.select(id_column, "outcome", said.alias("differences"))


def failure(error_class: Column, message: Column, path: Column) -> Column:
    """A short reason without the place of the file: every spelling of its path becomes its own name."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    back, slash = F.replace(path, F.lit("/"), F.lit("\\")), F.replace(path, F.lit("\\"), F.lit("/"))
    out = message
    for spelling in (F.replace(back, F.lit("\\"), F.lit("\\\\")), back, slash, path):
        out = F.when(spelling != name, F.replace(out, spelling, name)).otherwise(out)
    return F.concat_ws(" ", error_class, out)


def breach(docs: DataFrame, span_rows: DataFrame, text_column: str = "text", error_column: str = "error", id_column: str = "doc_id") -> DataFrame:
    """One row over a corpus: files assessed and failed, people at least and at most, files by sensitive category and by grade, the worst
    grade, and whether a person must look. A corpus of which nothing could be read is an error."""
    ok, bad = docs.where(F.col(error_column).isNull()), docs.where(F.col(error_column).isNotNull())
    people = risk.breach_subjects(risk.breach_types(span_rows))
    rated = risk.reidentification(ok, text_column)
    worst = F.max(F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.col("risk_grade")))
    grades = rated.groupBy("risk_grade").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_grade", "n")))).alias("grades"))
    kinds = risk.breach_section26(ok, text_column).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "files")))).alias("section26"))
    totals = rated.agg(F.count("*").alias("assessed"), F.element_at(F.array(*[F.lit(g) for g in GRADES]), F.greatest(F.coalesce(worst, F.lit(1)), F.lit(1)).cast("int")).alias("worst_grade"))
    failed = bad.agg(F.count("*").alias("failed"))
    one = totals.crossJoin(F.broadcast(failed)).crossJoin(F.broadcast(people)).crossJoin(F.broadcast(grades)).crossJoin(F.broadcast(kinds))  # one row each
    checked = F.when(F.col("assessed") == 0, F.raise_error(F.lit("nothing could be assessed"))).otherwise(F.col("assessed"))
    return one.withColumn("assessed", checked).withColumn("human_review", (F.col("failed") > 0) | F.col("worst_grade").isin("D", "F"))


# What an audit row may say.
STEPS = ("ingest", "detect", "anonymize", "send", "reverse", "validate", "export", "sanitize", "restore", "analyze")
RESULTS, LAYERS = ("pass", "fail", "halt", "blocked"), ("FP", "TB", "FN")


def audit_view(rows: DataFrame) -> DataFrame:
    """Audit rows as they are shown: steps, layers and results of the known lists or null, counts and times only where they are finite
    and not negative, and the number of flags in place of their words."""
    known = lambda c, names: F.when(F.col(c).isin(*names), F.col(c))
    number = lambda c: F.when((F.col(c) >= 0) & (F.col(c).cast("double") < float("inf")), F.col(c))
    return rows.select(
        "type", "session_id", known("step", STEPS).alias("step"), known("layer", LAYERS).alias("layer"), known("validation_result", RESULTS).alias("validation_result"), number("timestamp").alias("timestamp"),
        number("entity_count").alias("entity_count"), number("latency_ms").alias("latency_ms"), F.coalesce(F.size("flags"), F.lit(0)).cast("long").alias("flag_count"),
    )
