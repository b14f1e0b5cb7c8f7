"""Queries on pages, receipts, breaches, audit rows, jobs and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark, evaluation, identifiers, pages, receipts
from ..streaming import jobs, state
from .queries import made, query, table


def _keys(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "CAST(event_id DIV 10 AS BIGINT) AS doc_id", "CAST(event_id % 10 AS INT) AS page")


def _lines(spark, sf):
    """Ten events are a document; each is a page of two words."""
    rows = _keys(spark, sf).selectExpr("doc_id", "page", "concat('p', CAST(event_id AS STRING)) AS a", "concat('s', CAST(event_id % 97 AS STRING)) AS b")
    words = rows.selectExpr("doc_id", "page", "a", "inline(array(struct(0 AS i, a AS text, 0 AS s), struct(1 AS i, b AS text, length(a) + 1 AS s)))")
    words = words.select("doc_id", "page", "i", "text", (F.col("i") * 100).cast("double").alias("x"), F.lit(10.0).alias("y"), F.lit(40.0).alias("width"), F.lit(12.0).alias("height"), "s", (F.col("s") + F.length("text")).alias("e"))
    return rows.select("doc_id", "page", F.concat_ws(" ", "a", "b").alias("text")), words


_PAGE = "concat('p', CAST(event_id AS STRING), ' s', CAST(event_id % 97 AS STRING))"
_KEYS = "CAST(event_id // 10 AS BIGINT) AS doc_id, CAST(event_id % 10 AS INT) AS page"


@query(f"SELECT CAST(event_id // 10 AS BIGINT) AS doc_id, string_agg({_PAGE}, chr(10) || chr(10) ORDER BY event_id) AS text, CAST(2 * count(*) AS BIGINT) AS right_places, CAST(0 AS BIGINT) AS wrong FROM events GROUP BY 1")
def page_join(spark, sf):
    """Pages become one text, and each word still says what stands at its place."""
    texts, words, wrong = pages.join_pages(*_lines(spark, sf))
    w = words.join(texts.withColumnRenamed("text", "_t"), "doc_id")
    right = w.groupBy("doc_id").agg(F.sum((F.substring(F.col("_t"), F.col("s") + 1, F.col("e") - F.col("s")) == F.col("text")).cast("long")).alias("right_places"))
    bad = wrong.groupBy("doc_id").agg(F.count("*").alias("w"))
    return texts.join(right, "doc_id").join(bad, "doc_id", "left").select("doc_id", "text", "right_places", F.coalesce("w", F.lit(0)).cast("long").alias("wrong"))


@query(f"SELECT {_KEYS}, CASE WHEN event_id % 4 = 1 THEN 'new' WHEN event_id % 4 = 2 THEN 'p' || event_id || 'x' WHEN event_id % 4 = 3 THEN 'a@b.com' END AS text FROM events WHERE event_id % 4 <> 0")
def layer_merge(spark, sf):
    """Recognition reads each page's first word again: the same, elsewhere, with more letters, or as an address that the layer lacks."""
    _, words = _lines(spark, sf)
    n = _keys(spark, sf).selectExpr("doc_id", "page", "event_id % 4 AS k")
    first = words.where("i = 0").join(n, ["doc_id", "page"])
    k = F.col("k")
    read = first.select("doc_id", "page", "i", F.when(k == 0, F.upper("text")).when(k == 1, "new").when(k == 2, F.concat("text", F.lit("x"))).otherwise("a@b.com").alias("text"), F.when(k == 1, 500.0).otherwise(F.col("x") + 4).alias("x"), "y", "width", "height", "s", "e")
    return pages.merge_layers(words, read).where("source = 'ocr'").select("doc_id", "page", "text")


@query(f"SELECT {_KEYS}, CAST(CASE event_id % 3 WHEN 0 THEN 2 ELSE 3 END AS BIGINT) AS words, CAST(CASE event_id % 3 WHEN 0 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence, event_id % 3 <> 0 AS human_review FROM events")
def ocr_attempts(spark, sf):
    """A second, less sure reading brings the same words, a new place, or a phone over a word."""
    _, words = _lines(spark, sf)
    k = (F.col("doc_id") * 10 + F.col("page")) % 3
    second = F.col("attempt") == 2
    both = words.drop("s", "e").withColumn("attempt", F.explode(F.when(F.col("i") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    both = both.withColumns({"text": F.when(second & (k == 2), "0812345678").otherwise(F.col("text")), "x": F.when(second & (k == 1), 700.0).otherwise(F.col("x"))})
    sure = _keys(spark, sf).selectExpr("doc_id", "page", "inline(array(struct(1 AS attempt, CAST(0.9 AS DOUBLE) AS confidence), struct(2 AS attempt, CAST(0.6 AS DOUBLE) AS confidence)))")
    kept, used = pages.merge_attempts(both, sure)
    return kept.groupBy("doc_id", "page").agg(F.count("*").alias("words")).join(used, ["doc_id", "page"]).select("doc_id", "page", "words", "confidence", "human_review")


@query(f"SELECT {_KEYS}, event_id % 3 = 1 OR event_id % 3 = 2 AND event_id % 2 = 0 AS again, CASE WHEN event_id % 3 = 1 THEN 400 WHEN event_id % 3 = 2 AND event_id % 2 = 0 THEN 500 END AS dpi FROM events")
def ocr_retries(spark, sf):
    """After one attempt always again, after two if none was sure, after three never."""
    n = _keys(spark, sf).selectExpr("doc_id", "page", "explode(sequence(1, CASE event_id % 3 WHEN 0 THEN 3 ELSE CAST(event_id % 3 AS INT) END)) AS attempt", "CASE WHEN event_id % 2 = 0 THEN 0.5D ELSE 0.95D END AS confidence")
    return pages.more_attempts(n).select("doc_id", "page", "again", "dpi")


@query("SELECT CAST(event_id // 10 AS BIGINT) AS doc_id, CAST(2 * count(*) AS BIGINT) AS boxes, CAST(0 AS BIGINT) AS bare FROM events GROUP BY 1")
def entity_boxes(spark, sf):
    """A span over each whole page touches the boxes of both its words."""
    texts, words, _ = pages.join_pages(*_lines(spark, sf))
    spans = words.groupBy("doc_id", "page").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("page")
    boxes, bare = pages.boxes_of(spans, words, texts)
    lost = bare.groupBy("doc_id").agg(F.count("*").alias("n"))
    return boxes.groupBy("doc_id").agg(F.count("*").alias("boxes")).join(lost, "doc_id", "left").select("doc_id", "boxes", F.coalesce("n", F.lit(0)).cast("long").alias("bare"))


@query("SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE c_custkey % 7 WHEN 0 THEN 'unsupported_schema' WHEN 1 THEN 'malformed_receipt' WHEN 2 THEN 'source_mismatch' WHEN 3 THEN 'recompute_failed' WHEN 4 THEN 'result_mismatch' WHEN 5 THEN 'source_mismatch' ELSE 'match' END AS outcome, CASE c_custkey % 7 WHEN 1 THEN 'result.digest' WHEN 4 THEN 'result.digest,result.entity_count' ELSE '' END AS result_fields FROM customer")
def receipt_outcomes(spark, sf):
    """All six outcomes, and a document that is gone."""
    d = made(spark, sf, "customer", "c_custkey", "concat('mail ', c_name, '@example.com')")
    d = d.withColumn("spans", F.transform(identifiers.emails("text"), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit("EMAIL").alias("data_type"), F.lit("FP").alias("redact_type"))))
    k = F.col("doc_id") % 7
    old = receipts.issue(d)
    old = old.withColumn("schema", F.when(k == 0, "receipt/0").otherwise(F.col("schema"))).withColumn("fields", F.when(k == 1, F.map_filter("fields", lambda a, _: a != "result.digest")).otherwise(F.col("fields")))
    now = d.where(k != 5).withColumn("text", F.when(k == 2, F.concat("text", F.lit("."))).otherwise(F.col("text"))).withColumn("spans", F.when(k == 4, F.array().cast(d.schema["spans"].dataType)).otherwise(F.col("spans")))
    again = receipts.issue(now).withColumn("error", F.when(k == 3, "unreadable"))
    out = receipts.verify(old, again)
    return out.select("doc_id", "outcome", F.concat_ws(",", F.filter("differences", lambda x: x.startswith("result."))).alias("result_fields"))


@query("SELECT count(*) FILTER (c_custkey % 10 <> 0) AS assessed, count(*) FILTER (c_custkey % 10 = 0) AS failed, count(*) FILTER (c_custkey % 10 <> 0) AS subjects_min, CASE WHEN count(*) FILTER (c_custkey % 10 <> 0 AND c_custkey % 3 = 0) > 0 THEN 'F' ELSE 'A' END AS worst_grade, true AS human_review FROM customer")
def breach_report(spark, sf):
    """Every tenth file cannot be read; every third that can tells enough to find a person."""
    text = "CASE WHEN c_custkey % 3 = 0 THEN 'นาย ก แขวง ข อายุ 30 ปี ' ELSE '' END || concat(c_name, '@example.com')"
    d = made(spark, sf, "customer", "c_custkey", text).withColumn("error", F.when(F.col("doc_id") % 10 == 0, "unknown encoding"))
    found = identifiers.find(d.where("error IS NULL"), ("EMAIL",))
    return receipts.breach(d, found).select("assessed", "failed", "subjects_min", "worst_grade", "human_review")


@query("SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'FileNotFoundError no such file: ' || c_name || '.txt' AS reason FROM customer")
def failure_reasons(spark, sf):
    """The folder of a file is told in no spelling."""
    c = table(spark, sf, "customer")
    path = F.concat(F.lit("/srv/data/q1/"), "c_name", F.lit(".txt"))
    shown = F.when(F.col("c_custkey") % 3 == 0, path).when(F.col("c_custkey") % 3 == 1, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(F.replace(path, F.lit("/"), F.lit("\\\\")))
    return c.select(F.col("c_custkey").cast("long").alias("doc_id"), receipts.failure(F.lit("FileNotFoundError"), F.concat(F.lit("no such file: "), shown), path).alias("reason"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'detect' WHEN 1 THEN 'send' END AS step, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS DOUBLE) END AS latency_ms, CAST(event_id % 3 AS BIGINT) AS flag_count FROM events")
def audit_projection(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select(
        "event_id", F.lit("process").alias("type"), k.cast("string").alias("session_id"), F.when(k % 3 == 0, "detect").when(k % 3 == 1, "send").otherwise("look at john@x.com").alias("step"), F.lit("FP").alias("layer"), F.lit("pass").alias("validation_result"), k.cast("double").alias("timestamp"),
        k.alias("entity_count"), F.when(k % 4 == 0, -1.0).otherwise(k.cast("double")).alias("latency_ms"), F.when(k % 3 > 0, F.array_repeat(F.lit("some words"), (k % 3).cast("int"))).alias("flags"),
    )
    return receipts.audit_view(e).select(F.col("session_id").cast("long").alias("event_id"), "step", "latency_ms", "flag_count")


@query("""SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'rejected' ELSE 'run' END AS verdict, CASE event_id % 5 WHEN 0 THEN 'unknown_operation' WHEN 4 THEN 'invalid_payload' END AS error,
    CASE event_id % 5 WHEN 1 THEN '{"types": {"EMAIL": 1}}' WHEN 2 THEN '{"spans": [[5, 12, "EMAIL"]]}' WHEN 3 THEN '{"text": "mail a@b.com", "entities": 1}' END AS result FROM events""")
def job_results(spark, sf):
    """Jobs to analyze, detect and mask and restore; one operation is unknown, one payload lacks its text."""
    k = F.col("event_id") % 5
    e = table(spark, sf, "events").select(
        F.lit(1).alias("contract_version"), F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"), F.when(k == 0, "fly").when(k == 1, "analyze").when(k == 2, "detect").otherwise("roundtrip").alias("operation"),
        F.when(k == 4, "{}").otherwise('{"text": "mail a@b.com"}').alias("payload"),
    )
    return jobs.run_jobs(e).select("seq", "verdict", "error", "result")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id < 6 THEN 'created' ELSE 'recreated' END WHEN 1 THEN 'active' WHEN 2 THEN 'wrong_mode' WHEN 3 THEN 'closed' WHEN 4 THEN 'already_closed' ELSE 'recreated' END AS state FROM events""")
def session_lifecycle(spark, sf):
    """Six events in turn: use after a long pause, use, use in another mode, close, close again, use."""
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.lit(1).alias("session_id"), (F.floor(k / 6) * 5000 + k % 6).cast("double").alias("at"), k.alias("seq"), F.when((k % 6).isin(3, 4), "close").otherwise("use").alias("kind"), F.when(k % 6 == 2, "surrogate").otherwise("token").alias("mode"))
    return jobs.lifecycle(e).select("event_id", "state")


@query("SELECT user_id, len(list(event_id)) AS sent, list_aggregate(list_slice(list_sort(list(event_id)), -8, -1), 'min') AS oldest FROM events GROUP BY user_id".replace("len(list(event_id)) AS sent", "CAST(least(8, count(*)) AS BIGINT) AS sent"))
def trusted_texts(spark, sf):
    """Of each user the last eight texts are known again."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_id").alias("digest"))
    return jobs.trusted_digests(e, "user_id").select("user_id", F.size("digests").cast("long").alias("sent"), F.array_min("digests").alias("oldest"))


@query("SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'text_too_long' WHEN doc_id % 70 > 64 THEN 'too_many_phases' END AS refused FROM documents")
def detector_budget(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return jobs.within_budget(d, (F.col("doc_id") % 70).cast("int"), most_chars=20_000).select("doc_id", "refused")


@query("SELECT user_id AS session_id, max(event_id) AS last_use FROM events GROUP BY user_id QUALIFY row_number() OVER (ORDER BY last_use DESC, session_id DESC) > 5")
def session_evictions(spark, sf):
    """Each user is a session; all but the five used last must go."""
    return state.least_recent(table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("at")), cap=5)


@query("SELECT CAST(p_partkey AS BIGINT) AS prompt_id, CASE WHEN p_partkey % 3 = 0 THEN 'answer ' || p_partkey END AS response FROM part")
def cached_responses(spark, sf):
    """Of three prompts one has a response, one has it in another schema, and one was asked with another model."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("prompt_id"), F.concat(F.lit("find "), F.col("p_partkey").cast("string")).alias("prompt"), F.col("p_name").alias("text"))
    k = F.col("prompt_id") % 3
    asked = evaluation.cache_keys(p.where(k != 2), "model 1").unionByName(evaluation.cache_keys(p.where(k == 2), "model 0"))
    known = asked.select("key", F.when(k == 1, 1).otherwise(2).alias("schema"), F.concat(F.lit("answer "), F.col("prompt_id").cast("string")).alias("response"))
    return evaluation.cached(evaluation.cache_keys(p, "model 1"), known, 2).select("prompt_id", "response")


@query("SELECT doc_id FROM documents WHERE source <> 'src0' AND text IN (SELECT text FROM documents WHERE source = 'src0')")
def contaminated_rows(spark, sf):
    """One source is held out for a test: texts of the others that also stand in it."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    return evaluation.contaminated(d.where("source <> 'src0'"), d.where("source = 'src0'")).select("doc_id")


@query("SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(1 + CAST(c_custkey % 2 AS INT) AS BIGINT) AS unlocatable FROM customer WHERE c_custkey % 5 <> 0")
def unlocatable_values(spark, sf):
    """Two claimed values stand in no text (one for even keys), one does; every fifth text holds all that is claimed of it."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), "c_name", F.concat(F.lit("08-"), F.col("c_custkey").cast("string")).alias("c_phone"))
    k = F.col("doc_id")
    docs = c.select("doc_id", F.concat(F.col("c_name"), F.lit(" "), F.when(k % 5 == 0, F.concat("c_phone", F.lit(" nowhere gone"))).otherwise("")).alias("text"))
    claims = F.array(F.struct(F.lit("NAME").alias("t"), F.col("c_name").alias("v")), F.struct(F.lit("PHONE").alias("t"), F.col("c_phone").alias("v")), F.struct(F.lit("PLATE").alias("t"), F.when(k % 2 == 1, "nowhere").otherwise(F.col("c_name")).alias("v")))
    values = c.select("doc_id", F.explode(claims).alias("x")).select("doc_id", F.col("x.t").alias("data_type"), F.col("x.v").alias("value")).where((F.col("data_type") != "PLATE") | (k % 2 == 1))
    found = evaluation.locate_values(docs, values).join(docs, "doc_id").withColumn("value", F.expr("substring(text, s + 1, e - s)"))
    return benchmark.unlocated(values, found).select("doc_id", "unlocatable")
