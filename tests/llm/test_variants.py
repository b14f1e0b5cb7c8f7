"""op11: words one edit apart against brute force, with all cases that the docstring states."""

import random
import re
import zlib
from collections import Counter

import pytest

from veilspan.llm import variants

DOCS = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out = {}
    for w, k in n.items():
        near = [x for x in n if distance(w, x) == 1]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * k else None
        out[w] = [form, w, k, len(near), n[form] if form else None]
    for row in out.values():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def result(rows):
    got = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in rows]
    assert len(got) == len(dict(got))
    return dict(got)


def corpus(seed, n_docs=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    docs = []
    for d in range(n_docs):
        picked = []
        for _ in range(60):
            word = stems[min(int(rng.expovariate(0.2)), 24)]
            if rng.random() < 0.25:
                i = rng.randrange(len(word) + 1)
                word = word[:i] + rng.choice(["", "a", "b", "é", "Z"]) + word[i + rng.randrange(2) :]
            picked.append(word)
        docs.append((d, rng.choice([" ", "-", "4"]).join(picked)))
    return docs + [(n_docs, "chainaaa " * 6 + "chainaab " * 40 + "chainabb " * 250)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = result(variants.variants(spark.createDataFrame(docs, DOCS).repartition(5)).collect())
    want = plain(docs)
    assert got == want and any(r[0] for r in want.values()) and any(r[0] and r[0] != r[1] for r in want.values())


def test_crowded_halves_and_small_shards(spark):
    words = [("stammm" + a + b + c, 5 + i) for i, (a, b, c) in enumerate((a, b, c) for a in "abcde" for b in "abcde" for c in "abcde")] + [("xtammmaaa", 9), ("stammmaaaa", 7)]
    df = spark.createDataFrame(words, "word string, n long")
    want = sorted((a, b, n) for a, _ in words for b, n in words if distance(a, b) == 1)
    for grid, shard_chars in ((10_000, 2_000_000), (7, 50), (1, 2_000_000)):
        assert sorted(map(tuple, variants.near_words(df, grid, shard_chars).collect())) == want


def test_rests_find_what_one_edit_finds():
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab") for _ in range(7)), i) for i in range(100)]
    rests = variants.Rests(rows)
    for n in (7, 8):
        for _ in range(300):
            text = "".join(rng.choice("ab") for _ in range(n))
            assert rests.find(text) == {i for r, i in rows if distance(r, text) == 1}


def test_occurrence_hashes_are_crc32():
    import numpy as np

    rng = random.Random(6)
    prefixes, words = [f"{rng.randrange(10**9)}:".encode() for _ in range(200)], [bytes(rng.randrange(256) for _ in range(rng.randint(0, 64))) for _ in range(200)]
    got = variants._hashes(np.array([zlib.crc32(p) for p in prefixes], np.uint32), np.array([len(w) for w in words]), np.array([zlib.crc32(w) for w in words], np.uint32))
    assert got.tolist() == [zlib.crc32(p + w) for p, w in zip(prefixes, words)]


def test_stated_cases(spark):
    long = "x" * 30_001
    docs = [(None, "colour Colour COLOUR colour colour"), (1, None), (2, ""), (3, "color " * 40), (3, "color " * 40), (4, "colouré " * 5 + "colour× " * 5), (5, f"{long} {long}y " * 6), (6, "тест " * 9 + "short " * 9)]
    df = spark.createDataFrame([(*r, "w", 1) for r in docs], f"{DOCS}, word string, n long")
    got = result(variants.variants(df).collect())
    want = plain([r for r in docs if r[0] != 5])
    assert {w: r for w, r in got.items() if len(w) < 100} == want
    assert {w[-3:]: r[3] for w, r in got.items() if len(w) > 100} == {"xxx": 1, "xxy": 1}
    assert variants.variants(df.limit(0)).collect() == []
