"""op12: the search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from veilspan.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return ["".join(c.lower() if c < "\x80" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, top=50):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, n = sum(sum(c.values()) for _, c in counts), len(counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, text in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(text))
    out = []
    for i, ts in wanted.items():
        scores = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=700):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÄÖ", "x1y"]
    pick = lambda k: " ".join(words[min(int(rng.expovariate(0.06)), len(words) - 1)] for _ in range(k))
    docs = [(d, pick(rng.choice([1, 3, 10, 80]))) for d in range(n)]
    docs += [(n + d, docs[7][1]) for d in range(120)]  # copies: equal scores
    return docs, [(i, pick(rng.randint(1, 12))) for i in range(15)]


@pytest.mark.parametrize(("seed", "block_terms", "block_bytes"), [(1, 50_000, 4 << 20), (2, 20, 4 << 20), (3, 50_000, 4_000)])
def test_equals_brute_force(spark, seed, block_terms, block_bytes):
    docs, items = corpus(seed)
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), block_terms=block_terms, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


def test_pruning_keeps_the_best(spark):
    docs, items = corpus(4)
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), top=3, block_bytes=3_000)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 3)


def test_stated_cases(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "..."), (4, "alpha " * 200_000 + "gamma"), (5, "alpha beta"), (5, "alpha beta"), (5, "beta"), (-6, "ALPHA-beta_2x"), (7, "Ärger ärger")]
    items = [(1, "alpha, Beta"), (1, "gamma"), (2, None), (3, ""), (None, "alpha"), (4, "nowhere"), (5, "Ärger"), (6, "2X")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], f"{DOCS}, rank int, term string")
    wanted = spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, lexical.search(df, wanted).collect()), key=repr) == plain(docs, items)
    assert lexical.search(df.limit(0), wanted).collect() == [] and lexical.search(df, wanted.limit(0)).collect() == []
