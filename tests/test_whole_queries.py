"""Cases in which a query was wrong, or did not fit, before: each of these tests failed then."""

import random
import re

import duckdb

from veilspan import catalog
from veilspan.functions.layout import spread
from veilspan.operators import benchmark, evaluation, matching, outbound, structured
from veilspan.streaming import jobs


def as_sql(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, got.select(columns).collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_numbers_that_pass_as_a_citizens_are_no_subjects(spark, tmp_path):
    rows = [(1, "mail a@b.com or C@d.org"), (2, "ref 1101700230708 a@B.com"), (3, "1-1017-00230-70-8"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = as_sql(spark, tmp_path, "breach_subjects")
    assert got == want == [(2, 2, 0)]


def test_texts_that_hide_nothing_do_not_wait_beside_python(spark, tmp_path):
    d = spark.createDataFrame([(1, "x" * 50), (2, "โทร 081  23   45678"), (3, None)], "doc_id long, masked string")
    d.write.parquet(str(tmp_path / "d"))
    out = outbound.with_disguised(spark.read.parquet(str(tmp_path / "d")), "masked")
    assert {r.doc_id: len(r.disguised) for r in out.collect()} == {1: 0, 2: 1, 3: 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")
    assert len(plan) == 2 and "Filter" in plan[1] and "Union" in plan[0]


def test_a_split_of_many_narrow_rows_becomes_many_tasks(spark, tmp_path):
    spark.range(600_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    d = spark.read.parquet(str(tmp_path / "one"))
    assert spread(d).rdd.getNumPartitions() == 24


def test_resampling_goes_by_counts_not_by_documents(spark):
    rows = [(i % 5, i % 3, i % 2) for i in range(90)]
    one, other = ([(k * (i + 1), *r) for i, r in enumerate(rows)] for k in (1, 1009))
    schema = "doc_id long, tp long, fp long, fn long"
    assert evaluation.bootstrap(spark.createDataFrame(one, schema), 200).head() == evaluation.bootstrap(spark.createDataFrame(other, schema), 200).head()


def plain_lifecycle(rows, ttl):
    out, state = {}, {}
    for session, at, seq, kind, mode in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        last = state.get(session)
        new = last is None or at - last["at"] > ttl or (last["kind"] == "close" and kind == "use")
        life = {"mode": mode, "closed": False} if new else last
        if kind == "close":
            out[seq] = "already_closed" if new or life["closed"] else "closed"
        else:
            out[seq] = ("created" if last is None else "recreated") if new else "wrong_mode" if mode != life["mode"] else "active"
        state[session] = {"at": at, "kind": kind, "mode": life["mode"], "closed": life["closed"] or kind == "close"}
    return out


def test_one_session_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BLOCK_ROWS", 20, raising=False)
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), float(i * 10 + rng.randint(0, 60)), i, rng.choice(["use", "use", "use", "close"]), rng.choice("ab")) for i in range(400)]
    out = jobs.lifecycle(spark.createDataFrame(rows, "session_id long, at double, seq long, kind string, mode string"), 50.0)
    assert {r.seq: r.state for r in out.collect()} == plain_lifecycle(rows, 50.0)
    calls = []
    monkeypatch.setattr(jobs, "settle", lambda df: calls.append(df) or df.cache(), raising=False)
    jobs.lifecycle(spark.createDataFrame(rows, "session_id long, at double, seq long, kind string, mode string"), 50.0).collect()
    assert calls[0].where("session_id = 1").select("_b").distinct().count() > 5


def test_spans_are_compared_in_tasks_that_are_not_merged(spark):
    key = "doc_id long, s int, e int, data_type string"
    a = spark.createDataFrame([(1, 0, 2, "A"), (1, 0, 2, "A"), (1, 3, 4, "A"), (2, 0, 1, None), (None, 1, 2, "B")], key)
    b = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 5, "A"), (2, 0, 1, None), (3, 0, 1, "B"), (3, 0, 1, "B")], key)
    row = benchmark.span_f1(a, b).head()
    assert (row.tp, row.fp, row.fn) == (1, 3, 3)
    row = benchmark.agreement_sets(a, b).head()
    assert (row.same, row.only_a, row.only_b) == (1, 3, 3)
    plan = benchmark.span_f1(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" in plan


def test_what_is_found_is_not_looked_for_twice(spark, tmp_path):
    spark.createDataFrame([(1, "โทร 0812345678"), (2, "none"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    rows = structured.span_rows(structured.detect(d))
    assert [(r.doc_id, r.data_type, r.value) for r in rows.collect()] == [(1, "PHONE", "0812345678")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1


def test_many_short_texts_are_many_groups(spark):
    rows = [(i, i, f"0811111111 {i}") for i in range(100)]
    texts = spark.createDataFrame(rows, "doc_id long, session_id long, text string")
    pairs = texts.selectExpr("session_id", "'0811111111' AS pseudonym", "'x' AS original")
    found = matching.find(texts, pairs, "session_id", "text", "doc_id", "pseudonym", "original", limits=(500, 500, 1000))
    assert found.count() == 100
    groups = re.findall(r"pmod\(xxhash64\(.*?\), (\d+)\)", found._jdf.queryExecution().optimizedPlan().toString())
    assert max(map(int, groups)) >= 40
