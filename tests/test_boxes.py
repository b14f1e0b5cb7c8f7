"""Boxes met by cells, spans and words met by strips, and covered characters, each against all pairs or all characters."""

import random

import pytest

from veilspan.operators import evaluation, pages

BOX = "doc_id long, page int, i int, text string, x double, y double, width double, height double"


def share(a, b):
    wide = max(min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]), 0.0)
    high = max(min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]), 0.0)
    least = min(a[6] * a[7], b[6] * b[7])
    return wide * high / least if least else 0.0


def boxes(rng, n, pages_=3):
    out = []
    for i in range(n):
        big = rng.random() < 0.05
        size = (rng.uniform(50, 400), rng.uniform(50, 300)) if big else (rng.uniform(1, 40), rng.uniform(1, 12))
        out.append((rng.randrange(2), rng.randrange(pages_), i, "w", rng.uniform(-50, 500), rng.uniform(0, 300), *size))
    return [*out, (0, 0, n, "none", 5.0, 5.0, 0.0, 9.0), (0, 0, n + 1, "negative", 5.0, 5.0, -4.0, 9.0), (1, 1, n + 2, "far", 1e7, 1e7, 3.0, 3.0), (1, 1, n + 3, "null", None, 5.0, 3.0, 3.0)]


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_boxes_meet_as_if_all_pairs_were_tried(spark, least):
    rng = random.Random(71)
    a, b = boxes(rng, 160), boxes(rng, 140)
    b += [(*r[:2], 1000 + k, *r[3:]) for k, r in enumerate(a[:40])]  # equal boxes
    met = pages.meet(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ("a", "b"), least)
    have = sorted((r.a.i, r.b.i) for r in met.collect())
    want = sorted((x[2], y[2]) for x in a for y in b if x[:2] == y[:2] and None not in (*x, *y) and x[6] > 0 and y[6] > 0 and share(x, y) >= least)
    assert have == want and have


def test_a_page_of_many_boxes_is_many_cells(spark):
    """50,000 words in rows: each box meets itself and no more, in no more than four cells."""
    d = spark.range(50_000).selectExpr("CAST(1 AS BIGINT) AS doc_id", "1 AS page", "CAST(id AS INT) AS i", "'w' AS text", "CAST(id % 250 * 10 AS DOUBLE) AS x", "CAST(id DIV 250 * 12 AS DOUBLE) AS y", "9D AS width", "11D AS height")
    met = pages.meet(d, d, ("a", "b"), 0.5)
    assert met.count() == 50_000 and not met.where("a.i <> b.i").count()


def test_no_boxes(spark):
    none, some = spark.createDataFrame([], BOX), spark.createDataFrame([(1, 1, 0, "w", 0.0, 0.0, 5.0, 5.0)], BOX)
    assert pages.meet(none, some, ("a", "b"), 0.5).count() == pages.meet(some, none, ("a", "b"), 0.5).count() == 0
    assert [r.source for r in pages.merge_layers(some, none).collect()] == ["layer"]
    assert [r.source for r in pages.merge_layers(none, some).collect()] == ["ocr"]


def test_spans_meet_words_as_if_all_pairs_were_tried(spark):
    rng = random.Random(72)
    text = "".join(rng.choice("abc  ") for _ in range(900))
    words, at = [], 0
    while at < 880:
        n = rng.choice([1, 3, 7, 70, 150])
        words.append((1, 0, len(words), at, min(at + n, 900), float(at), 0.0, float(n), 10.0))
        at += n + rng.choice([0, 1, 5])
    spans = [(1, s, min(s + rng.choice([1, 5, 64, 200]), 900)) for s in rng.sample(range(890), 60)] + [(1, 64, 64), (1, 0, 900)]
    d = spark.createDataFrame(words, "doc_id long, page int, i int, s int, e int, x double, y double, width double, height double")
    got, bare = pages.boxes_of(spark.createDataFrame(spans, "doc_id long, s int, e int"), d, spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert sorted((r.s, r.e, r.x) for r in got.collect()) == sorted((s, e, w[5]) for _, s, e in spans for w in words if w[3] < e and s < w[4])
    uncovered = {i for i in range(900) if text[i] != " "} - {i for w in words for i in range(w[3], w[4])}
    assert {(r.s, r.e) for r in bare.collect()} == {(s, e) for _, s, e in spans if uncovered & set(range(s, e))}


def test_covered_characters(spark):
    rng = random.Random(73)
    made = lambda: [(rng.randrange(4), s, s + rng.choice([0, 1, 4, 30])) for s in (rng.randrange(120) for _ in range(60))]
    gold, predicted = [*made(), (7, 3, 9)], [*made(), (8, 0, 2)]
    d = lambda rows: spark.createDataFrame(rows, "doc_id long, s int, e int")
    chars = lambda rows, doc: {i for k, s, e in rows if k == doc for i in range(s, e)}
    for r in evaluation.coverage(d(gold), d(predicted)).collect():
        g, p = chars(gold, r.doc_id), chars(predicted, r.doc_id)
        assert (r.gold_chars, r.predicted_chars, r.common_chars) == (len(g), len(p), len(g & p))


def test_attempts_are_merged_without_broadcasts_and_read_once(spark, monkeypatch):
    from veilspan.functions import layout

    monkeypatch.setattr(layout, "MOST_BROADCAST", 0, raising=False)
    written = []
    monkeypatch.setattr(pages, "settle", lambda df: written.append(df) or layout.settle(df), raising=False)
    # page 0: a new place, a phone over a word, the same word; page 1: the phone is told by the surest attempt already; page 2: one attempt
    rows = [(0, 0, 0, "one", 0.0, 1), (0, 0, 1, "two", 100.0, 1), (0, 0, 0, "far", 700.0, 2), (0, 0, 1, "0812345678", 0.0, 2), (0, 0, 2, "Two.", 100.0, 2), (0, 0, 3, "new", 0.0, 2), (0, 1, 0, "0812345678", 100.0, 1), (0, 1, 1, "w", 0.0, 1), (0, 1, 0, "0812345678", 0.0, 2), (0, 2, 0, "alone", 0.0, 5)]
    words = spark.createDataFrame([(*r[:5], 0.0, 40.0, 12.0, r[5]) for r in rows], BOX + ", attempt int")
    sure = spark.createDataFrame([(0, 0, 1, 0.9), (0, 0, 2, 0.6), (0, 1, 1, 0.9), (0, 1, 2, 0.6), (0, 2, 5, 0.5)], "doc_id long, page int, attempt int, confidence double")
    kept, used = pages.merge_attempts(words, sure)
    assert sorted((r.page, r.attempt, r.text) for r in kept.collect()) == [(0, 1, "one"), (0, 1, "two"), (0, 2, "0812345678"), (0, 2, "far"), (1, 1, "0812345678"), (1, 1, "w"), (2, 5, "alone")]
    assert sorted(used.collect()) == [(0, 0, 0.6, True), (0, 1, 0.9, False), (0, 2, 0.5, True)]
    plans = [str(d._jdf.queryExecution().executedPlan().toString()) for d in [*written, kept, used]]
    assert written and not [p for p in plans if "BroadcastHashJoin" in p]
