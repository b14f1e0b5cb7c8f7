"""Risk analytics: re-identification, sensitive categories, reports, breach and subject search. Native expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def grade(score: Column) -> Column:
    return F.when(score <= 20, "A").when(score <= 40, "B").when(score <= 60, "C").when(score <= 80, "D").otherwise("F")


def reidentification(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with qi (quasi-identifiers found), combination, risk_score and risk_grade."""
    t = F.coalesce(F.col(text_column), F.lit(""))
    found = {k: t.rlike("(?U)" + p) for k, p in V.QUASI.items()}
    combo = found["gender"] & found["district"] & (found["date_of_birth"] | found["age"])
    base = sum((F.when(c, 10.0).otherwise(0.0) for c in found.values()), F.lit(0.0))
    score = F.least(F.when(combo, F.greatest(base, F.lit(85.0))).otherwise(base), F.lit(100.0))
    qi = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]), lambda x: x.isNotNull())
    return docs.withColumns({"qi": qi, "combination": combo, "risk_score": score, "risk_grade": grade(score)})


def section26(text: str | Column) -> Column:
    """array<struct<category,s,e,value>>: the first match of each sensitive category, in the order of the list."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    each = []
    for k, p in V.SECTION26.items():
        value = F.regexp_extract(t, f"(?U)({p})", 1)
        s = F.length(F.element_at(F.split(t, "(?U)" + p, 2), 1))
        each.append(F.when(value != "", F.struct(F.lit(k).alias("category"), s.alias("s"), (s + F.length(value)).alias("e"), value.alias("value"))))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def report(docs: DataFrame, spans: str = "spans", text_column: str = "text") -> DataFrame:
    """doc-level report: direct identifiers, categories, re-identification, the overall score (the worst of the three) and grade."""
    d = reidentification(docs, text_column).withColumn("section26", F.transform(section26(text_column), lambda x: x.category))
    direct = F.coalesce(F.size(spans), F.lit(0))
    fp = F.size(F.filter(F.coalesce(F.col(spans), F.array().cast(docs.schema[spans].dataType)), lambda x: x.redact_type == "FP"))
    overall = F.greatest(F.least(direct * 15.0, F.lit(100.0)), F.col("risk_score"), F.least(F.size("section26") * 20.0, F.lit(100.0)))
    advice = F.filter(
        F.array(
            F.when(direct > 0, F.concat(F.lit("pseudonymise direct identifiers: "), direct.cast("string"))), F.when(F.size("section26") > 0, F.concat(F.lit("explicit consent needed: "), F.concat_ws(", ", "section26"))),
            F.when(F.col("combination"), F.lit("break up the combination of quasi-identifiers")), F.when(overall >= 60, F.lit("collect less")),
        ),
        lambda x: x.isNotNull(),
    )
    return d.withColumns({"direct_count": direct, "fp_count": fp, "tb_count": direct - fp, "overall_score": overall, "overall_grade": grade(overall), "advice": advice})


def breakdown(span_rows: DataFrame) -> DataFrame:
    """Counts by type and layer, most first, ties by first appearance (doc, start)."""
    return span_rows.groupBy("data_type", "redact_type").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "s")).alias("first")).orderBy(F.desc("n"), "first").drop("first")


def breach_types(span_rows: DataFrame) -> DataFrame:
    """Total and exactly distinct canonical values of each type."""
    return span_rows.groupBy("data_type").agg(F.count("*").alias("total"), F.countDistinct(X.canonical("data_type", "value")).alias("distinct_values"))


def breach_subjects(types: DataFrame) -> DataFrame:
    """One row: at least as many people as the most frequent strong identifier has values, at most as all together; names apart."""
    strong = F.when(F.col("data_type").isin(*V.STRONG_TYPES), F.col("distinct_values"))
    return types.agg(
        F.coalesce(F.max(strong), F.lit(0)).alias("subjects_min"), F.coalesce(F.sum(strong), F.lit(0)).alias("subjects_max"),
        F.coalesce(F.max(F.when(F.col("data_type") == "NAME", F.col("distinct_values"))), F.lit(0)).alias("name_distinct"),
    )


def breach_risk(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """How many documents have each grade."""
    return reidentification(docs, text_column).groupBy("risk_grade").agg(F.count("*").alias("files"))


def breach_section26(docs: DataFrame, text_column: str = "text") -> DataFrame:
    return docs.select(F.explode(F.transform(section26(text_column), lambda x: x.category)).alias("category")).groupBy("category").agg(F.count("*").alias("files"))


def subjects(lines: DataFrame, column: str = "line") -> DataFrame:
    """(data_type, canonical) of each line that is not blank, by its shape."""
    t = F.regexp_replace(F.col(column), r"(?U)\A\s+|\s+\z", "")
    compact = F.regexp_replace(t, r"(?U)[\s-]", "")
    kind = (
        F.when(compact.rlike(r"(?U)^\d{13}$"), "THAI_ID").when(t.rlike(r"^[A-Z]{2}\d{7}$"), "PASSPORT").when(t.contains("@"), "EMAIL")
        .when(compact.rlike(r"^0\d{8,9}$") | compact.rlike(r"^\+?66\d{8,9}$"), "PHONE").otherwise("NAME")
    )
    return lines.where(t != "").select(kind.alias("data_type"), X.canonical(kind, t).alias("canonical"))


def locate(span_rows: DataFrame, who: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Documents that mention a subject: matches by the subject's types, other people's data, and whether only a name matched.

    Every span is read under each type the subject has, whatever the detector called it. A bare run of digits that begins with 66 is
    not a phone number: the international form counts only with its "+". The join is on (type, value), spans on the large side.
    """
    types = who.select("data_type").distinct().withColumnRenamed("data_type", "subject_type")
    kinds = [r[0] for r in types.collect()]  # five types at most
    digits = F.regexp_replace("value", r"(?U)\D", "")
    forms = F.array(*[F.struct(F.lit(k).alias("subject_type"), (F.when(F.col("value").rlike(r"\+\s*66"), X.canonical(F.lit("PHONE"), "value")).otherwise(digits) if k == "PHONE" else X.canonical(F.lit(k), "value")).alias("canonical")) for k in sorted(kinds)])
    read = span_rows.select(id_column, "data_type", F.explode(forms).alias("f")).select(id_column, "data_type", "f.*")
    hits = read.join(who.distinct().withColumnRenamed("data_type", "subject_type"), ["subject_type", "canonical"])
    by_doc = hits.groupBy(id_column).agg(F.count("*").alias("matches"), F.array_sort(F.collect_set("subject_type")).alias("matched_types"))
    totals = span_rows.groupBy(id_column).agg(F.count("*").alias("spans"))
    return by_doc.join(totals, id_column).select(id_column, "matches", "matched_types", (F.col("spans") > F.col("matches")).alias("third_party_possible"), (F.col("matched_types") == F.array(F.lit("NAME"))).alias("weak_only"))


def digest(docs: DataFrame, schema: str, spans: str = "spans", id_column: str = "doc_id") -> DataFrame:
    """A digest over what was found, not over values: sorted [s,e,type,layer] as compact JSON after the schema's name."""
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.data_type.alias("t"), x.redact_type.alias("l"))))
    one = lambda x: F.concat(F.lit("["), x.s.cast("string"), F.lit(","), x.e.cast("string"), F.lit(',"'), x.t, F.lit('","'), x.l, F.lit('"]'))
    body = F.concat(F.lit("["), F.array_join(F.transform(rows, one), ","), F.lit("]"))
    return docs.select(F.col(id_column), F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(schema + "\n"), body), 256)).alias("digest"), F.size(spans).alias("entity_count"))


def claims_differ(issued: DataFrame, again: DataFrame) -> DataFrame:
    """Fields (id, field, value) of two receipts that are not the same, either side possibly missing."""
    a, b = issued.withColumnRenamed("value", "issued"), again.withColumnRenamed("value", "recomputed")
    return a.join(b, ["doc_id", "field"], "full").where(~F.col("issued").eqNullSafe(F.col("recomputed")))


def quality(docs: DataFrame, text_column: str = "text", least_thai: float = 0.1) -> DataFrame:
    """docs with pattern_ok, structure_ok, quality_score and quality_grade of plain texts."""
    t = F.coalesce(F.col(text_column), F.lit(""))
    solid = F.regexp_count(t, F.lit(r"(?U)\S"))
    thai = F.regexp_count(t, F.lit("[฀-๿]"))
    odd = F.regexp_count(t, F.lit(r"[?�]"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"(?U)\S"))
    n = F.size(lines)
    average = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / n
    single = F.size(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")) == 1))
    pattern_ok = (solid > 0) & ((thai / solid >= least_thai))
    garbled = (solid > 0) & (odd / solid > 0.05)
    structure_ok = (n > 0) & ~(average < 3) & ~((n > 5) & (single / n > 0.3))
    score = F.lit(100.0) - F.when(~F.coalesce(pattern_ok, F.lit(False)), 40.0).when(garbled, 15.0).otherwise(0.0) - F.when(~F.coalesce(structure_ok, F.lit(False)), 30.0).otherwise(0.0)
    mark = F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").when(score >= 20, "D").otherwise("F")
    return docs.withColumns({"pattern_ok": F.coalesce(pattern_ok, F.lit(False)), "structure_ok": F.coalesce(structure_ok, F.lit(False)), "quality_score": score, "quality_grade": mark})
