"""Cases that queries once left out: each of these tests failed before the query did the whole job."""

from veilspan import catalog


def test_the_second_look_sees_every_event(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.event_id: r.n for r in catalog.QUERIES["second_look_digits"](spark, sf).collect()}
    assert got == {r.event_id: float(r.event_id % 7) for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
