"""Repeated passages: recall of fuzzy ones against a brute-force aligner, parts in earlier documents, rows that share an id."""

import random
from collections import defaultdict

import pytest

from veilspan.llm import passages

DOCS = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def changed(rng, p, rate, indels):
    out = []
    for w in p:
        u = rng.random()
        if u >= rate:
            out.append(w)
        elif indels and u < 0.2 * rate:
            continue
        elif indels and u < 0.4 * rate:
            out += [w, *words(rng, 1)]
        else:
            out += words(rng, 1)
    return out


def alike(a, b):
    """Longest common subsequence over the longer length, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / max(len(a), len(b))


def test_recall_by_identity(spark):
    rng = random.Random(61)
    rows, planted = [], []
    for n in (80, 120, 200):
        for rate in (0.05, 0.1, 0.15, 0.18):
            for indels in (False, True):
                for _ in range(12):
                    p = words(rng, n)
                    q = changed(rng, p, rate, indels)
                    planted.append((len(rows) + 1, 30, 30 + len(q), alike(p, q)))
                    rows += [(len(rows) + k, " ".join(words(rng, 30) + t + words(rng, 30))) for k, t in enumerate((p, q))]
    found = defaultdict(list)
    for r in passages.repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect():
        assert r.ref_doc_id == r.doc_id - 1 and r.identity >= passages.IDENTITY
        found[r.doc_id].append(r)
    for low, least in ((0.95, 0.95), (0.9, 0.9), (0.85, 0.75), (0.8, 0.5)):
        band = [x for x in planted if low <= x[3] < low + 0.05 or low == 0.95 and x[3] >= low]
        caught = [sum(min(r.start_word + r.n_words, e) - max(r.start_word, s) for r in found[d]) >= 0.8 * (e - s) for d, s, e, _ in band]
        print(low, len(band), sum(caught) / len(band))
        assert sum(caught) / len(band) >= least, low


def test_a_changed_passage_behind_documents_with_its_parts(spark):
    """Every tenth word is changed, and each fifth of the passage also stands in a document of its own before both."""
    rng = random.Random(62)
    p = words(rng, 200)
    q = [w if i % 10 != 9 else "changed" + str(i) for i, w in enumerate(p)]
    rows = [(i, " ".join(words(rng, 40) + p[40 * i : 40 * i + 40] + words(rng, 40))) for i in range(5)]
    rows += [(100, " ".join(words(rng, 20) + p)), (101, " ".join(words(rng, 20) + p + words(rng, 20))), (102, " ".join(q + words(rng, 20)))]
    found = passages.repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert any(r.doc_id == 101 and r.ref_doc_id == 100 and r.start_word <= 20 and r.n_words >= 200 for r in found)
    assert any(r.doc_id == 102 and r.ref_doc_id == 101 and r.n_words >= 190 for r in found)


def test_rows_of_one_id_lose_only_their_own_passages(spark):
    rng = random.Random(63)
    p, own = words(rng, 60), words(rng, 80)
    rows = [(1, " ".join(words(rng, 20) + p), "x"), (5, " ".join(p + ["end"] * 3), "y"), (5, " ".join(own), "z"), (5, " ".join(own), "again"), (None, " ".join(own), "null"), (7, None, None)]
    d = spark.createDataFrame(rows, DOCS + ", _cuts string").repartition(3)
    kept = passages.remove_repeats(d).collect()
    assert sorted((r.doc_id or 0, r.text and len(r.text.split())) for r in kept if r.doc_id != 7) == [(0, 80), (1, 80), (5, 3), (5, 80)]
    assert [r._cuts for r in kept if r.doc_id == 7] == [None] and passages.remove_repeats(d).columns == d.columns
    found = passages.repeats(d).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} == {(5, 1), (5, 5)}


@pytest.mark.parametrize("n", [90, 400])
def test_texts_that_repeat_themselves_give_few_rows(spark, n):
    rows = [(0, "so " * 90), (1, "so " * n), (2, "a b c " * n), (3, "x " + "a b c " * n)]
    found = passages.repeats(spark.createDataFrame(rows, DOCS)).collect()
    for d, e in ((1, n), (3, 3 * n)):
        mine = [r for r in found if r.doc_id == d]
        assert len(mine) <= 2 + 2 * n // 40
        for s in range(0 if d == 1 else 1, e - 50):
            assert any(r.start_word <= s and r.start_word + r.n_words >= s + 50 for r in mine), s


def test_no_words_go_that_no_kept_document_has(spark):
    """1 and 2, 2 and 3 are alike, 1 and 3 are not: 2 goes, 3 stays. And what two documents share exactly goes also behind a third."""
    rng = random.Random(64)
    p = words(rng, 100)
    q = [w if i % 7 else f"two{i}" for i, w in enumerate(p)]
    r = [w if i % 7 != 3 else f"three{i}" for i, w in enumerate(q)]
    x, y = words(rng, 60), words(rng, 70)
    rows = [(1, p), (2, q), (3, r), (10, x), (11, x + y), (12, words(rng, 30) + x + y), (13, y + words(rng, 30))]
    d = spark.createDataFrame([(i, " ".join(words(rng, 40) + t)) for i, t in rows], DOCS).repartition(3)
    kept = {k.doc_id: k.text.split()[40:] for k in passages.remove_repeats(d).collect()}
    assert kept[1] == p and len(kept[2]) <= 4 and kept[3] == r  # changed words at the ends are no part of it
    assert kept[10] == x and kept[11] == y and len(kept[12]) == 30 and kept[13] == rows[-1][1][70:]


@pytest.mark.parametrize("taken,want", [
    ([], [(5, 100)]), ([(0, 30)], [(25 + 6, 74)]), ([(100, 130)], [(5, 84)]), ([(40, 60)], [(5, 24), (61, 44)]), ([(0, 200)], []), ([(12, 108)], []),
])
def test_free_parts(taken, want):
    """A passage of 100 words from word 5, which lies at 10 to 110 of the earlier document; six words did not align."""
    import pyarrow as pa

    row = {"doc_id": 1, "start_word": 5, "n_words": 100, "ref_start_word": 10, "ref_n_words": 100, "matched_words": 94, "_taken": [{"s": s, "e": e} for s, e in taken]}
    (batch,) = passages._free_parts(0.0)([pa.RecordBatch.from_pylist([row], pa.schema([("doc_id", pa.int64()), *((c, pa.int32()) for c in ("start_word", "n_words", "ref_start_word", "ref_n_words", "matched_words")), ("_taken", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))]))])
    got = [(r["start_word"], r["n_words"]) for r in batch.to_pylist()]
    assert got == [x for x in want if x[1] - 6 >= 0]


@pytest.mark.parametrize("rate", [0.05, 0.1])
def test_changed_copies_behind_many_documents_with_parts(spark, rate):
    """Six documents hold 45 words of a passage each, before its original and between that and its copy: these are neither the first
    nor the one before of any seed."""
    rng = random.Random(65)
    rows, want = [], []
    for t in range(20):
        p = words(rng, 100)
        q = [w if rng.random() >= rate else w + "x" for w in p]
        held = [p[:45], p[28:73], p[55:], p, p[:45], p[28:73], p[55:], q]
        rows += [(100 * t + i, " ".join(words(rng, 30) + x + words(rng, 30))) for i, x in enumerate(held)]
        want.append(100 * t + 7)
    found = passages.repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    caught = {r.doc_id for r in found if r.ref_doc_id == r.doc_id - 4 and r.n_words >= 80}
    print(rate, len(caught))
    assert len(caught) >= (20 if rate == 0.05 else 18)
    assert all(r.identity >= passages.IDENTITY and r.n_words >= passages.MIN_WORDS for r in found)


def test_many_documents_of_a_pair_of_seeds_meet_in_blocks():
    """Each later document that looks meets each earlier one once, whatever the blocks are."""
    import numpy as np
    import pyarrow as pa

    rng, n = random.Random(66), 40
    is_open = np.array([rng.random() < 0.5 for _ in range(n)])
    who = np.arange(n, dtype=np.int64) * 3
    row = {"key": 0, "twos": passages._pack(np.full(n, 77, np.uint64)), "ids": passages._names(who), "xi": passages._ints(np.arange(n)), "xj": passages._ints(np.arange(n) + 60), "open": np.packbits(is_open).tobytes()}
    met = {}
    for block in (1000, 7):
        asked = passages._meetings(5, block)(pa.Table.from_pylist([row], passages._arrow(passages._TWOS)))
        ext = asked.append_column("begin", asked.column("xi")).append_column("words", pa.array([b"xy" * 65] * len(asked)))
        met[block] = sorted((r["doc_id"], r["ref"]) for g in set(ext.column("grp").to_pylist()) for r in passages._pairs(5, 50, 0.8)(ext.filter(pa.compute.equal(ext.column("grp"), g))).to_pylist())
    assert met[7] == met[1000] == sorted((int(a), int(b)) for i, a in enumerate(who) if is_open[i] for b in who[:i])


def test_places_of_a_pair_of_seeds_are_laid_out_in_tiles():
    """Texts that repeat themselves give one pair of seeds at very many places: their words are not laid out all at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    docs, each = 400, 50
    n, rng = docs * each, np.random.default_rng(67)
    who, at = np.repeat(np.arange(docs), each), np.tile(np.arange(each), docs)
    texts = [rng.integers(0, 60_000, 250, dtype=np.uint16).tobytes() if d % 40 else b"xy" * 250 for d in range(docs)]
    cols = {"doc_id": who, "grp": who * 0, "two": who * 0, "role": np.where(who % 20 == 0, 3, 2).astype(np.int32), "xi": (at + 96).astype(np.int32), "xj": (at + 126).astype(np.int32), "begin": at.astype(np.int32)}
    table = pa.table(cols | {"words": pa.array([texts[d] for d in who], pa.binary())})
    tracemalloc.start()
    found = passages._pairs(5, 50, 0.8)(table)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    print(n, len(found), round(peak))
    assert set(zip(found.column("doc_id").to_pylist(), found.column("ref").to_pylist())) == {(a, b) for a in range(0, docs, 40) for b in range(0, a, 40)}
    assert peak < 60
    some = table.filter(pa.compute.less(table.column("doc_id"), 100))
    assert sorted(map(str, passages._pairs(5, 50, 0.8, 60)(some).to_pylist())) == sorted(map(str, passages._pairs(5, 50, 0.8)(some).to_pylist()))


def test_meetings_leave_in_pieces_without_places_that_nobody_meets():
    """A document holds a pair of seeds at 500 places, those that look for it at two: two of them go on. No table grows with the pairs."""
    import numpy as np
    import pyarrow as pa

    who = np.concatenate([np.zeros(500, np.int64), np.repeat(np.arange(1, 41), 2)])
    row = {"key": 0, "twos": passages._pack(np.full(len(who), 77, np.uint64)), "ids": passages._names(who), "xi": passages._ints(np.arange(len(who))), "xj": passages._ints(np.arange(len(who)) + 60), "open": np.packbits(who > 0).tobytes()}
    table = pa.Table.from_pylist([row], passages._arrow(passages._TWOS))
    pieces = list(passages._met(5, 1000, 10)(table))
    assert max(map(len, pieces)) == 10 and sum(map(len, pieces)) == 82
    assert sum(map(len, passages._met(5, 4, 10)(table))) == len(passages._meetings(5, 4)(table)) > 400


def test_pairs_of_seeds_are_the_same_however_many_are_told_at_once():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(68)
    who = np.repeat(np.arange(20), 30)
    tok, pos = np.array([rng.randrange(9) for _ in who], np.uint64), np.concatenate([sorted(rng.sample(range(300), 30)) for _ in range(20)])
    order = np.lexsort((pos, who, tok))
    row = {"key": 0, "run": 1, "toks": passages._pack(tok[order]), "ids": passages._names(who[order]), "pos": passages._ints(pos[order]), "open": np.packbits(tok[order] < 4).tobytes()}
    table = pa.Table.from_pylist([row], passages._arrow(passages._SEEDS))
    got = [sorted(zip(*(c.tolist() for c in passages._joined(pa.concat_tables(passages._twos(3, n)(table)), ("twos", "ids", "xi", "xj", "open"))))) for n in (10_000, 37)]
    want = sum(12 <= b - a <= 112 for d in range(20) for i, a in enumerate(pos[who == d]) for b in pos[who == d][i + 1 :])
    assert got[0] == got[1] and len(got[0]) == want
