"""A polled queue as a stream: jobs survive a restart between poll and submit, and none is submitted twice."""

from pathlib import Path

import pytest

from tests import fake_queue
from veilspan.sources import queue
from veilspan.streaming import jobs


def job(i, **more):
    return {"contract_version": 1, "job_id": f"j{i}", "operation": "detect", "payload": {"text": f"user{i}@example.com"}} | more


@pytest.fixture
def waiting(spark, tmp_path):
    (tmp_path / "waiting").mkdir()
    (tmp_path / "results").mkdir()
    spark.dataSource.register(queue.JobQueue)
    return tmp_path / "waiting"


def stream(spark, tmp_path, **options):
    return spark.readStream.format("job_queue").option("poll", "tests.fake_queue:poll").option("path", str(tmp_path / "segments")).option("waiting", str(tmp_path / "waiting")).options(**options).load()


def test_a_restart_between_poll_and_submit(spark, waiting, tmp_path):
    fake_queue.put(waiting, [job(i) for i in range(7)] + ["no envelope", job(8, contract_version=2)])

    def work(submit):
        q = jobs.work_queue(stream(spark, tmp_path, mostJobs="4"), submit, str(tmp_path / "cp")).trigger(once=True).start()
        try:
            q.awaitTermination(120)
        except Exception as e:
            return str(e)
        return None

    def broken(batch, number):
        raise RuntimeError("the queue is away")

    def submit(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / "results" / f"batch={number}"))

    done = lambda: {r.job_id: r for r in spark.read.parquet(str(tmp_path / "results")).collect() if r.job_id}
    assert "the queue is away" in work(broken)
    assert all(p.name.endswith(".taken") for p in waiting.iterdir())  # the queue has forgotten them
    assert len(list((tmp_path / "segments").glob("*.jsonl"))) == 3
    assert work(submit) is None
    rows = spark.read.parquet(str(tmp_path / "results")).collect()
    assert len(rows) == 9 and len({r.seq for r in rows}) == 9
    assert sorted(r.job_id for r in rows if r.error is None) == [f"j{i}" for i in range(7)]
    assert [r.error for r in rows if r.job_id == "j8"] == ["unsupported_version"] and [r.error for r in rows if r.job_id is None] == ["invalid_job_id"]

    fake_queue.put(waiting, [job(20), job(21)])
    assert work(submit) is None
    assert len(done()) == 10 and done()["j20"].seq > max(r.seq for r in rows)
    assert work(submit) is None and spark.read.parquet(str(tmp_path / "results")).count() == 11  # nothing waits: nothing is submitted
    assert len(list((tmp_path / "segments").glob("*.jsonl"))) <= 1


def test_segments(tmp_path):
    (tmp_path / "waiting").mkdir()
    reader = queue._Reader({"path": str(tmp_path / "s"), "poll": "tests.fake_queue:poll", "mostJobs": "2", "waiting": str(tmp_path / "waiting")})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions({"segment": 0}, {"segment": 0}) == []
    fake_queue.put(tmp_path / "waiting", [job(i) for i in range(5)])
    assert reader.latestOffset() == {"segment": 3}
    read = [r for p in reader.partitions({"segment": 0}, {"segment": 3}) for r in reader.read(p)]
    assert [r[1] for r in read] == [f"j{i}" for i in range(5)] and [r[2] for r in read] == sorted({r[2] for r in read})
    reader.commit({"segment": 3})
    again = queue._Reader(reader.options)
    assert again.latestOffset() == {"segment": 3} and not list(Path(tmp_path / "s").glob("*.jsonl"))
    fake_queue.put(tmp_path / "waiting", [job(9)])
    assert again.latestOffset() == {"segment": 4}
    with pytest.raises(ValueError):
        queue._Reader({"path": "x"})


@pytest.mark.parametrize("given,row", [
    (None, (None, None, 3, None, None)), ({"contract_version": True}, (-1, None, 3, None, None)), ({"contract_version": 2**40, "job_id": 5}, (-1, "5", 3, None, None)),
    ({"contract_version": 1, "job_id": "a", "operation": "detect", "payload": "{}"}, (1, "a", 3, "detect", "{}")),
])
def test_envelopes(given, row):
    assert queue._envelope(given, 3) == row
