"""The stages of corpus_pipeline against brute-force versions, and on awkward tables."""

import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from test_operators import brute_groups
from veilspan.llm import packing, passages, quality, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, _gone string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents that are clean, toxic, poor, copies, near copies or share a passage; nulls, repeated ids, an extra column."""
    rng = random.Random(81)
    rows, labels = [], []

    def add(text, good=1, toxic=0, i=None, label=True):
        i = len(rows) if i is None else i
        rows.append((i, text, "en", rng.choice(["a", "b"]), None if text is None else len(text), "x"))
        if label:
            labels.append((i, good, toxic))

    for _ in range(260):
        add(" ".join(s.capitalize() + "." for s in (words(rng, rng.randint(5, 15)) for _ in range(rng.randint(2, 8)))))
    for _ in range(60):
        add(f"You {rng.choice(['scumbag', 'vermin', 'wretch'])} {words(rng, 12)}. {words(rng, 8)} {rng.choice(['scumbag', 'vermin', 'wretch'])}.", toxic=1)
    for _ in range(60):
        add(" ".join(rng.choice(["$$$", "!!!", "CLICK", "BUY", "%%"]) for _ in range(rng.randint(20, 60))), good=0)
    p = words(rng, 70)
    for i in (3, 40, 90):
        rows[i] = (i, rows[i][1] + " " + p + " " + words(rng, 20) + ".", "en", "a", None, "x")
    for i in (5, 6, 7):
        add(rows[i][1], label=False)
        add(rows[i][1] + " end", label=False)
    rows += [(None, rows[8][1], "en", "a", 1, "x"), (None, None, "en", "a", 1, "x"), (600, None, "en", "a", 1, "x"), (601, "", "en", "a", 0, "x"), (10, rows[10][1], "en", "a", 0, "x"), (10, words(rng, 90), "en", "b", 0, "y")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels + [(9999, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_are_those_of_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    known = lambda n, held: spark.createDataFrame([r for r in labels if r.doc_id is not None and fold(r.doc_id, n) != held], "doc_id long, quality int, toxic int")

    kept = corpus_pipeline.drop_toxic(spark, docs, tables)
    model = toxicity.train(docs, known(4, 2))
    assert in_order(kept) == sorted((tuple(r) for r in docs.collect() if model.score(pa.array([r.text or ""]))[0] < 0.3), key=repr)
    toxic = {r.doc_id for r in labels if r.toxic and r.doc_id is not None}
    left = {r.doc_id for r in kept.collect()}
    assert len(toxic & left) <= 2 and len({r.doc_id for r in labels if r.toxic == 0 and r.doc_id < 400} - left) <= 4

    docs = spark.createDataFrame(kept.collect(), COLUMNS)
    kept = corpus_pipeline.drop_poor(spark, docs, tables)
    net = quality.train(docs, known(3, 1))
    assert in_order(kept) == sorted((tuple(r) for r in docs.collect() if 1 / (1 + 2.718281828459045 ** -net.logit(quality.style(pa.array([r.text or ""])))[0]) >= 0.5), key=repr)

    docs = spark.createDataFrame(kept.collect(), COLUMNS)
    kept = in_order(corpus_pipeline.drop_near_copies(spark, docs, tables))
    rows = docs.collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    groups = brute_groups([(r.doc_id, r.text) for r in rows if r.doc_id is not None and len(texts[r.doc_id]) == 1])
    want = [r for r in rows if r.doc_id is None or len(texts[r.doc_id]) > 1 or groups[r.doc_id][0] == 0 or groups[r.doc_id][1] == r.doc_id]
    assert {r[0] for r in kept} == {r.doc_id for r in want}
    assert len([r for r in kept if r[0] == 10]) == 2 and sum(r[0] is None for r in kept) == sum(r.doc_id is None for r in rows)

    docs = spark.createDataFrame(kept, COLUMNS)
    cut = corpus_pipeline.cut_repeats(spark, docs, tables).collect()
    before = defaultdict(list)
    for r in docs.collect():
        before[r.doc_id].append(r.text)
    seen, n = set(), passages.MIN_WORDS
    shared = set()
    for i in sorted(k for k in before if k is not None):
        for t in before[i]:
            w = (t or "").split()
            runs = {tuple(w[s : s + n]) for s in range(len(w) - n + 1)}
            if runs & seen:
                shared.add(i)
            seen |= runs
    for r in cut:
        if r.doc_id not in shared:
            assert r.text in before[r.doc_id], r.doc_id
        elif r.text is not None:
            assert any(len(r.text.split()) <= len(t.split()) - n for t in before[r.doc_id])
    assert shared and [c for c in docs.columns] == cut[0].__fields__

    docs = spark.createDataFrame(cut, COLUMNS)
    out = corpus_pipeline.pack(spark, docs, tables).collect()
    assert sorted(sum(r.n_tokens for r in out if r.doc_id == i) for i in {r.doc_id for r in cut}) == sorted(sum(len((r.text or "").split()) + 1 for r in cut if r.doc_id == i) for i in {r.doc_id for r in cut})
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    assert all(sum(r.n_tokens for r in b) <= b[0].bin_capacity and b[0].bin_capacity in packing.CAPACITIES for b in bins.values())


def test_the_whole_pipeline_runs_and_stages_take_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 100
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).count() == 0, name
