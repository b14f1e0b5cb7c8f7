"""Queries on what surrounds a benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark
from ..sources import files
from .queries import _GOLD, _PRED, _sides, query, table

_KIND = "CASE event_id % 5 WHEN 0 THEN 'NAME' WHEN 1 THEN 'ADDRESS' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'ORGANIZATION' ELSE 'DATE' END"


@query(f"SELECT CASE WHEN {_KIND} IN ('NAME', 'ADDRESS', 'PHONE') THEN {_KIND} ELSE 'OUT_OF_SCHEME' END AS data_type, count(*) AS n, CAST((SELECT count(*) FROM events WHERE event_id % 5 > 2) AS BIGINT) AS excluded FROM events GROUP BY 1")
def type_scheme(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", f"{_KIND} AS data_type")
    return benchmark.in_scheme(e, False).groupBy("data_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(benchmark.excluded(e)))  # one row


@query("SELECT family, f2 FROM (VALUES ('people', CAST(0.45 AS DOUBLE)), ('numbers', CAST(0.4 AS DOUBLE))) t(family, f2)")
def macro_families(spark, sf):
    """A type that was never scored counts as nothing."""
    scores = spark.range(1).selectExpr("inline(array(struct('NAME' AS data_type, 0.9D AS f2), struct('PHONE' AS data_type, 0.8D AS f2)))")
    out = benchmark.families(scores, {"people": ("NAME", "ADDRESS"), "numbers": ("PHONE", "THAI_ID")})
    return out.select("family", F.round("f2", 9).alias("f2"))


@query("SELECT CAST(count(*) FILTER (user_id % 3 = 0 AND event_id % 4 = 0) AS BIGINT) AS false_positives, CAST(count(*) FILTER (user_id % 3 = 0) AS BIGINT) AS documents, CAST(count(*) FILTER (user_id % 3 = 0 AND event_id % 4 <> 0) AS BIGINT) AS clean_documents FROM events")
def negative_documents(spark, sf):
    """Events of every third user have no gold span; every fourth event has a prediction."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "user_id")
    return benchmark.negative_slice(e.where("user_id % 3 <> 0"), e.where("doc_id % 4 = 0"), e)


@query("SELECT CAST(count(*) FILTER (k > 0) AS BIGINT) AS unmatched, CAST(count(*) FILTER (k = 1) AS BIGINT) AS inside, CAST(count(*) FILTER (k = 2) AS BIGINT) AS outside FROM (SELECT event_id % 3 AS k FROM events)")
def address_audit(spark, sf):
    """Each document has one address; a second prediction lies within it, or after it."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"))
    gold = e.selectExpr("doc_id", "10 AS s", "50 AS e", "'ADDRESS' AS data_type")
    more = e.where("doc_id % 3 > 0").selectExpr("doc_id", "CASE doc_id % 3 WHEN 1 THEN 30 ELSE 60 END AS s", "CASE doc_id % 3 WHEN 1 THEN 45 ELSE 70 END AS e", "'ADDRESS' AS data_type")
    return benchmark.address_audit(gold, gold.withColumn("e", F.lit(20)).unionByName(more))


@query(f"WITH g AS (SELECT DISTINCT * FROM ({_GOLD})), p AS (SELECT DISTINCT * FROM ({_PRED})), t AS (SELECT count(*) AS tp FROM g NATURAL JOIN p), n AS (SELECT (SELECT tp FROM t) AS tp, (SELECT count(*) FROM p) - (SELECT tp FROM t) AS fp, (SELECT count(*) FROM g) - (SELECT tp FROM t) AS fn) SELECT tp, fp, fn, round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 9) AS f1 FROM n")
def span_f1(spark, sf):
    return benchmark.span_f1(*_sides(spark, sf)).select("tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query(f"""WITH a AS (SELECT DISTINCT * FROM ({_GOLD})), b AS (SELECT DISTINCT * FROM ({_PRED})), c AS (SELECT DISTINCT doc_id, data_type, unnest(range(s, e)) AS i FROM a), d AS (SELECT DISTINCT doc_id, data_type, unnest(range(s, e)) AS i FROM b)
    SELECT (SELECT count(*) FROM a NATURAL JOIN b) AS same, (SELECT count(*) FROM a ANTI JOIN b USING (doc_id, s, e, data_type)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id, s, e, data_type)) AS only_b,
    (SELECT count(*) FROM c NATURAL JOIN d) AS chars_both, (SELECT count(*) FROM c ANTI JOIN d USING (doc_id, data_type, i)) AS chars_a, (SELECT count(*) FROM d ANTI JOIN c USING (doc_id, data_type, i)) AS chars_b""")
def annotator_sets(spark, sf):
    return benchmark.agreement_sets(*_sides(spark, sf))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'NAME' AS data_type, n_name AS value FROM nation WHERE n_nationkey % 6 <> 5 UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'PHONE', '0812' FROM nation WHERE n_nationkey % 6 IN (0, 3)")
def answer_rows(spark, sf):
    """An array, an object, an array in a fence, objects in prose, an array after a thought, a thought without an end."""
    row = "concat('{\"type\": \"name\", \"value\": \"', n_name, '\"}')"
    text = f"""CASE n_nationkey % 6 WHEN 0 THEN concat('[', {row}, ', {{"type": "PHONE", "value": "0812"}}]') WHEN 1 THEN {row} WHEN 2 THEN concat('```json', chr(10), '[', {row}, ']', chr(10), '```')
        WHEN 3 THEN concat('I found ', {row}, ' and {{"type": "PHONE", "value": "0812"}} here') WHEN 4 THEN concat('<think>[1]</think>[', {row}, ']') ELSE concat('<think>', {row}) END"""
    return benchmark.parse_answers(table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS doc_id", f"{text} AS answer"))


@query("SELECT CAST(n_nationkey AS STRING) AS doc_id, CASE n_nationkey % 8 WHEN 0 THEN 'unknown-slice' WHEN 1 THEN 'layer-mismatch' WHEN 2 THEN 'negative-has-markup' WHEN 3 THEN 'positive-doc-without-entities' WHEN 4 THEN 'thai-id-bad-checksum' WHEN 5 THEN 'unknown-type-COLOUR' WHEN 6 THEN 'unbalanced-markup' END AS error FROM nation WHERE n_nationkey % 8 <> 7 UNION ALL SELECT CAST(n_nationkey AS STRING), 'value-reused-across-docs' FROM nation WHERE n_nationkey % 8 = 4 AND CAST(n_nationkey AS STRING) <> (SELECT min(CAST(n_nationkey AS STRING)) FROM nation WHERE n_nationkey % 8 = 4) UNION ALL SELECT '<corpus>', 'type-below-minimum-IBAN'")
def draft_errors(spark, sf):
    """One error in each of seven of eight records, a number that several have, and a type that is missing from the corpus."""
    k = "n_nationkey % 8"
    good = "concat('[[NAME|', n_name, ']] ok')"
    d = table(spark, sf, "nation").selectExpr(
        "CAST(n_nationkey AS STRING) AS doc_id", f"CASE {k} WHEN 0 THEN 'poem' WHEN 2 THEN 'negative' ELSE 'medical' END AS slice", f"CASE {k} WHEN 1 THEN 'balanced' WHEN 2 THEN 'negative' ELSE 'natural' END AS layer",
        f"CASE {k} WHEN 3 THEN 'no marks' WHEN 4 THEN concat({good}, ' [[THAI_ID|1101700230700]]') WHEN 5 THEN concat({good}, ' [[COLOUR|red]]') WHEN 6 THEN concat({good}, ' [[NAME|') ELSE {good} END AS annotated",
    )
    return benchmark.validate_draft(d, {"IBAN": 1})


@query("SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(i AS INT) AS i, CASE i WHEN 2 THEN 'alignment_conflict' ELSE 'measured' END AS status, CAST(CASE i WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS accuracy FROM part, (VALUES (0), (1), (2)) t(i)")
def reading_accuracy(spark, sf):
    """A value that was read right, one with two of ten characters wrong, and a third that needs the first one's place."""
    n = "lpad(CAST(p_partkey % 1000 AS STRING), 4, '7')"
    p = table(spark, sf, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", f"concat('no. abcdef', {n}, ' / klmXYqrsti / end') AS text", f"concat('abcdef', {n}) AS a", f"concat('Abcdef', {n}) AS c")
    values = p.selectExpr("doc_id", "inline(array(struct(0 AS i, a AS value), struct(1 AS i, 'klmnoqrsti' AS value), struct(2 AS i, c AS value)))")
    return benchmark.reading_accuracy(values, p.select("doc_id", "text"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'removed' WHEN 1 THEN 'exposed' WHEN 2 THEN 'exposed' WHEN 3 THEN 'ink_above_box' ELSE 'unmeasurable' END AS verdict FROM events")
def residual_verdicts(spark, sf):
    k = F.col("event_id") % 5
    m = table(spark, sf, "events").select("event_id", F.when(k == 2, 0.4).when(k == 4, None).otherwise(1.0).alias("black"), F.when(k == 3, 0.2).otherwise(0.0).alias("above"), (k == 1).alias("text_survives"))
    return benchmark.residual(m).select("event_id", "verdict")


@query("SELECT CAST(sum(l_suppkey) AS BIGINT) AS found, count(*) AS inputs, CAST(count(*) FILTER (l_suppkey % 4 <> 0 AND l_partkey % 5 <> 0) AS BIGINT) AS passed, CAST(count(*) FILTER (l_suppkey % 4 = 0) + count(*) FILTER (l_partkey % 5 = 0) AS BIGINT) AS failures FROM lineitem")
def acceptance_rollup(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("input_id"), F.col("l_suppkey").alias("found"), "l_partkey")
    total, failed = benchmark.acceptance(runs, ["found"], {"residue": F.col("found") % 4 != 0, "coverage": F.col("l_partkey") % 5 != 0})
    return total.crossJoin(F.broadcast(failed.agg(F.count("*").alias("failures"))))  # one row each


@query("SELECT event_type AS version, count(*) AS reveals, CAST(greatest(150 - count(*), 0) AS BIGINT) AS left, count(*) > 150 AS over_budget FROM events GROUP BY 1")
def reveal_budget(spark, sf):
    return benchmark.reveals(table(spark, sf, "events").select(F.col("event_type").alias("version")), 150)


@query("SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'spaced' ELSE 'lost' END AS how FROM customer")
def value_survival(spark, sf):
    c = table(spark, sf, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS doc_id", "1 AS i", "concat('id ', c_name) AS value", "CASE c_custkey % 3 WHEN 0 THEN concat('an id ', c_name, '.') WHEN 1 THEN concat('an i d  ', c_name) ELSE 'nothing' END AS text")
    return benchmark.survival(c.drop("text"), c.select("doc_id", "text")).select("doc_id", "how")


@query("SELECT event_id // 10 AS doc_id, CAST(count(DISTINCT (event_id % 10) // 3) AS INT) AS n FROM events GROUP BY 1")
def box_rows(spark, sf):
    """Ten words of a page in rows of three."""
    k = F.col("event_id")
    w = table(spark, sf, "events").select(F.floor(k / 10).alias("doc_id"), F.lit(1).alias("page"), (k % 3 * 30).cast("double").alias("x"), (F.floor(k % 10 / 3) * 20 + k % 2).cast("double").alias("y"))
    return benchmark.rows_of_boxes(w).groupBy("doc_id").agg(F.max("row").alias("n"))


@query("SELECT count(*) AS paths, count(DISTINCT n_regionkey) AS files FROM nation")
def distinct_paths(spark, sf):
    """Each region's file is named in several ways."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey") % 3
    f = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".txt"))
    d = n.select(F.when(k == 0, F.concat(F.lit("/data/"), f)).when(k == 1, F.concat(F.lit("/data/./x/../"), f)).otherwise(F.concat(F.lit("//data//"), f)).alias("path"))
    return benchmark.distinct_files(d).agg(F.count("*").alias("files")).crossJoin(F.broadcast(d.agg(F.count("*").alias("paths"))))  # one row each


@query("SELECT slice, count(*) AS n, CAST(count(*) AS BIGINT) AS right_spans FROM (SELECT CASE WHEN i < 100 THEN 'hard_case' ELSE 'core' END AS slice FROM range(500) t(i)) GROUP BY slice")
def synthetic_corpus(spark, sf):
    """A fifth of the documents are hard cases, and each gold span says what it covers."""
    d = files.synthetic_gold(spark, 500)
    ok = F.forall("spans", lambda x: F.length(F.substring(F.col("text"), x.s + 1, x.e - x.s)) == x.e - x.s) & (F.size("spans") == 1)
    shaped = F.substring(F.col("text"), F.col("spans")[0]["s"] + 1, F.col("spans")[0]["e"] - F.col("spans")[0]["s"]).rlike(r"^(?:\+66[0-9]{9}|0[0-9]{9}|[0-9]{13}|[a-z0-9]+@[a-z.]+)$")
    return d.groupBy("slice").agg(F.count("*").alias("n"), F.sum((ok & shaped).cast("long")).alias("right_spans"))
