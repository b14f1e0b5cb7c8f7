"""Sessions with a state for each value: tokens that stay, locked modes, closing twice, disposal, expiry, restarts, eviction."""

import random
import time

import pytest

from veilspan.streaming import state

IN = "session_id string, message_id long, kind string, mode string, text string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def put(spark, folder, rows):
    spark.createDataFrame(rows, IN).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, **options):
    """What is waiting in the folder, from the checkpoint of the run before."""
    stream = spark.readStream.schema(IN).parquet(str(tmp_path / "in"))
    out = state.session_stream(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    q = out.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return {(r.session_id, r.message_id): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_sessions_over_restarts(rocks, tmp_path):
    phone = "โทร 0812345678"
    put(rocks, tmp_path / "in", [("s", 1, "mask", "token", phone), ("s", 2, "mask", None, phone + " a@b.com"), ("t", 1, "mask", None, phone), ("u", 1, "mask", "odd", phone), ("u", 2, "close", None, None), ("n", 1, "mask", None, None), ("n", 2, "fly", None, None)])
    first = run(rocks, tmp_path)
    assert (first["s", 1].outcome, first["s", 1].new_values, first["s", 2].new_values) == ("masked", 1, 1)
    assert first["s", 2].masked.startswith(first["s", 1].masked + " [อีเมล_") and first["t", 1].masked != first["s", 1].masked
    assert [first["u", i].outcome for i in (1, 2)] == ["unknown_mode", "unknown"]
    assert first["n", 1].masked == "" and first["n", 2].outcome == "unknown_kind"

    put(rocks, tmp_path / "in", [("s", 3, "mask", None, "again 0812345678, 0898765432"), ("s", 4, "mask", "surrogate", phone), ("s", 5, "trust", None, first["s", 1].masked), ("s", 6, "trust", None, "another"), ("t", 2, "close", None, None), ("t", 3, "close", None, None), ("t", 4, "mask", None, phone)])
    second = run(rocks, tmp_path)
    token = first["s", 1].masked.removeprefix("โทร ")
    assert second["s", 3].masked.startswith("again " + token) and second["s", 3].new_values == 1 and second["s", 3].masked.endswith("_2]")
    assert [second["s", i].outcome for i in (4, 5, 6)] == ["wrong_mode", "trusted", "not_trusted"]
    assert [second["t", i].outcome for i in (2, 3, 4)] == ["closed", "already_gone", "session_gone"]

    put(rocks, tmp_path / "in", [("s", 7, "dispose", None, None), ("s", 8, "dispose", None, None), ("s", 9, "trust", None, first["s", 1].masked)])
    third = run(rocks, tmp_path)
    assert [third["s", i].outcome for i in (7, 8, 9)] == ["disposed", "already_gone", "not_trusted"]


def test_only_the_last_texts_are_trusted(rocks, tmp_path):
    put(rocks, tmp_path / "in", [("s", i, "mask", None, f"text {i}") for i in range(12)])
    run(rocks, tmp_path)
    put(rocks, tmp_path / "in", [("s", 100 + i, "trust", None, f"text {i}") for i in range(12)])
    found = run(rocks, tmp_path)
    assert [found["s", 100 + i].outcome for i in range(12)] == ["not_trusted"] * 4 + ["trusted"] * 8


def test_idle_sessions_expire_and_are_forgotten(rocks, tmp_path):
    put(rocks, tmp_path / "in", [("s", 1, "mask", None, "0812345678")])
    old = run(rocks, tmp_path, ttl_ms=500, tombstone_ms=4000)
    time.sleep(1.0)
    put(rocks, tmp_path / "in", [("s", 2, "mask", None, "0812345678"), ("s", 3, "close", None, None)])
    found = run(rocks, tmp_path, ttl_ms=500, tombstone_ms=4000)
    assert found["s", 2].outcome == "session_gone" and found["s", 3].outcome == "already_gone"
    time.sleep(4.5)
    put(rocks, tmp_path / "in", [("s", 4, "close", None, None), ("s", 5, "mask", None, "0812345678")])
    last = run(rocks, tmp_path, ttl_ms=500, tombstone_ms=4000)
    assert last["s", 4].outcome == "unknown" and (last["s", 5].outcome, last["s", 5].new_values) == ("masked", 1)
    assert old["s", 1].masked == last["s", 5].masked


@pytest.mark.parametrize("cap", [1, 7, 40, 41])
def test_eviction_is_that_of_a_plain_twin(spark, cap):
    rng = random.Random(81)
    uses = [(f"s{rng.randrange(40)}", rng.randrange(30)) for _ in range(300)]
    last = {}
    for s, at in uses:
        last[s] = max(last.get(s, at), at)
    order = sorted(last, key=lambda s: (last[s], s))
    d = spark.createDataFrame([*uses, (None, 3), ("never", None)], "session_id string, at long")
    assert {r.session_id for r in state.least_recent(d, cap).collect()} == set(order[: max(0, len(order) - cap)])
    assert {r.kind for r in state.evict(d, cap).collect()} <= {"dispose"}
