"""Operators against plain versions: fingerprints byte by byte, packing with several capacities, license scans, unclosed elements."""

import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import extraction, fingerprint, licenses, packing, quality, toxicity

DOCS = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


# --- 1 ----------------------------------------------------------------------------------------------------------------------------
def plain_ends(data: bytes) -> list[int]:
    """Ends of chunks, one byte after the other."""
    gear = [int(x) for x in fingerprint.GEAR]
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) % 2**64  # the hash of the last 64 bytes; boundaries look at the last 32
        window = 0
        for j in range(max(0, i - 31), i + 1):
            window = (window + (gear[data[j]] << (i - j))) % 2**64
        size = i + 1 - start
        zero = (window >> 58 == 0) if size <= fingerprint.WANTED else (window >> 60 == 0)
        if len(data) - start > fingerprint.LEAST and (size >= fingerprint.LEAST and zero or size == fingerprint.MOST):
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(data)] if start < len(data) else [])


def test_chunks_are_those_of_one_byte_after_the_other():
    rng = random.Random(71)
    for n in [*range(0, 40), 200, 700, 1500]:
        data = words(rng, n).encode()[: n if n < 40 else None]
        if n % 3 == 0:
            data = bytes(rng.randrange(256) for _ in range(len(data)))
        assert fingerprint.chunk_ends(np.frombuffer(data, np.uint8)).tolist() == plain_ends(data), n


def test_containment_is_that_of_sets_of_chunks():
    rng = random.Random(72)
    for _ in range(40):
        a = words(rng, 120).encode()
        b = a[: len(a) // 2] + words(rng, 60).encode()

        def chunks(data):
            ends = plain_ends(data)
            return {data[s:e] for s, e in zip([0, *ends], ends)}

        x, y = chunks(a), chunks(b)
        assert fingerprint.Fingerprint(a).containment(fingerprint.Fingerprint(b)) == pytest.approx(sum(map(len, x & y)) / sum(map(len, x)))


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_a_hot_id_takes_several_parts_and_order_holds(spark, parts):
    rng = random.Random(73)
    rows = [(i, words(rng, 30)) for i in range(200)] + [(77, words(rng, 30)) for _ in range(150)] + [(None, words(rng, 30)) for _ in range(90)]
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    dealt = fingerprint.with_next(d, parts).withColumn("task", F.spark_partition_id()).where("copy = 0")
    assert dealt.count() == len(rows)
    if parts > 1:
        assert dealt.where("id = 77").select("part").distinct().count() > 1
    spans = sorted((r.lo, r.hi) for r in dealt.groupBy("part").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    import hashlib

    out = fingerprint.edit_report(d).collect()
    assert len(out) == len(rows)
    by_id = dict(rows[:200])
    for r in out:
        if r.doc_id not in (None, 76, 77):
            t, n = by_id[r.doc_id], by_id.get(r.doc_id + 1)
            if n is not None:
                half = len(t) // 2
                assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()


# --- 3 ----------------------------------------------------------------------------------------------------------------------------
def plain_pack(lengths, capacities, overhead):
    caps = sorted(capacities)
    bins = []  # [capacity, items]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = [b for b in bins if b[0] - sum(lengths[j] for j in b[1]) >= n]
        if fits:
            best = min(b[0] - sum(lengths[j] for j in b[1]) for b in fits)
            next(b for b in reversed(bins) if b in fits and b[0] - sum(lengths[j] for j in b[1]) == best)[1].append(i)
        else:
            m = max(n, 1)
            cost = {c: (c + overhead) / (c // m * m) for c in caps if c >= m}
            low = min(cost.values())
            bins.append([max(c for c in cost if cost[c] <= low), [i]])
    return sorted(min(c for c in caps if c >= sum(lengths[j] for j in b[1])) for b in bins), sum(len(b[1]) for b in bins)


@pytest.mark.parametrize("capacities", [(64,), (16, 64), (8, 16, 32, 64), (20, 50, 64)])
def test_packing_by_plain_search_of_all_bins(capacities):
    rng = random.Random(74)
    for _ in range(6):
        lengths = [rng.choice([0, 1, 2, 5, rng.randint(1, 64), rng.randint(1, 64)]) for _ in range(150)]
        b, _, cap = packing.pack_items(lengths, capacities, 3)
        got = sorted(dict(zip(b.tolist(), cap.tolist())).values())
        want, items = plain_pack(lengths, capacities, 3)
        assert items == len(lengths) and sum(got) == sum(want) and len(got) == len(want)


# --- 5 and 8 ----------------------------------------------------------------------------------------------------------------------
def test_samples_stay_exact_at_any_size(spark, monkeypatch):
    """A share of 1e-7 and less picks rows, and a hot id does not pass the bound."""
    from veilspan.llm._util import share_of

    n = 400_000
    ids = spark.range(n)
    assert ids.where(share_of(10 * n, 2_000, "id")).count() == pytest.approx(200, abs=60)
    whole = spark.range(20_000_000).where(share_of(100_000_000_000, 50_000, "id")).count()  # 5e-7 of them
    assert 1 <= whole <= 30
    rng = random.Random(75)
    rows = [(1 if i % 3 else i, words(rng, 8)) for i in range(900)]
    d = spark.createDataFrame(rows, DOCS)
    la = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda a, b, *r, f=quality.fit: (seen.append((len(a), len(b))), f(a, b, *r))[1])
    quality.train(d, la, max_positive=50, max_unlabelled=80)
    assert seen[0][0] <= 50 and 40 <= seen[0][1] <= 80
    monkeypatch.setattr(toxicity, "_fit", lambda r, c, n, *x, f=toxicity._fit: (seen.append(n), f(r, c, n, *x))[1])
    toxicity.train(d, la, max_train=60)
    assert seen[1] <= 60


# --- 6 ----------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("element", ["object", "noscript", "select", "svg", "iframe", "video"])
def test_unclosed_elements_do_not_swallow_the_page(spark, element):
    text = "Words of a paragraph that is long enough to be one of the article. " * 2
    html = f"<body><article><h1>Title of it</h1><p>{text}</p><{element} data-x=1><p>{text}</p><p>{text}</p></article></body>"
    closed = f"<body><article><h1>Title of it</h1><p>{text}</p><{element} data-x=1>hidden <i>words</i></{element}><p>{text}</p><p>{text}</p></article></body>"
    d = spark.createDataFrame([(1, "u", html), (2, "u", closed)], "page_id long, url string, html string")
    for r in extraction.extract(d).collect():
        assert r.text.split() == ("Title of it " + text * 3).split()


# --- 9 ----------------------------------------------------------------------------------------------------------------------------
def plain_find(text, templates):
    """Templates whose words stand in a text, exactly and one after the other."""
    have = licenses.words(text)
    found = []
    for name, t in templates.items():
        want = licenses.words(t)
        found += [(i, i + len(want), name) for i in range(len(have) - len(want) + 1) if have[i : i + len(want)] == want]
    return {n for s, e, n in found if not any(a <= s and e <= b and (a, b) != (s, e) for a, b, _ in found)}


@pytest.mark.parametrize("width", [40, 60, 72, 76, 80, 100, 0])
def test_notices_in_any_wrapping_are_found(spark, width):
    rng = random.Random(width)
    rows = []
    for i, (name, t) in enumerate(licenses.TEMPLATES.items()):
        body = "\n".join(textwrap.wrap(t, width)) if width else t
        rows.append((i, words(rng, 30) + "\n" + body + "\n" + words(rng, 30)))
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    names = list(licenses.TEMPLATES)
    caught = sum(any(r.doc_id == i and r.license in plain_find(text, licenses.TEMPLATES) and r.exact for r in got) for i, text in rows)
    assert caught / len(rows) >= 0.9, [(names[i], [(r.license, r.missing) for r in got if r.doc_id == i]) for i, _ in rows]


def test_long_templates_match(spark):
    rng = random.Random(76)
    long = "Permission to use this is granted under a license. " + words(rng, 3000)
    d = spark.createDataFrame([(1, words(rng, 50) + "\n" + long + "\n" + words(rng, 50)), (2, words(rng, 50) + "\n" + "\n".join(textwrap.wrap(long, 76)))], DOCS)
    got = {r.doc_id: r for r in licenses.scan(d, templates={"LONG": long}).collect()}
    assert got[1].exact and got[2].exact


# --- gradients --------------------------------------------------------------------------------------------------------------------
def test_toxicity_steps_go_down_the_penalised_loss():
    """The loss that _fit states, computed plainly, falls to where no small change of a weight lowers it by much."""
    import numpy as np

    from veilspan.llm import toxicity

    rng = np.random.default_rng(8)
    n, d, penalty, ridge = 60, 6, 4.0, 1e-2
    x = rng.random((n, d)) < 0.4
    x[:, 5] = rng.random(n) < 0.5
    y = (x[:, 0] | (rng.random(n) < 0.1)).astype(float)
    pair = np.flatnonzero(x[:, 5])
    twin = x[pair].copy()
    twin[:, 5], twin[:, 4] = False, True
    rows, cols = np.nonzero(x)
    trows, tcols = np.nonzero(twin)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    balance = np.sqrt(balance / balance.mean())

    def loss(w, b):
        z, zs = b + x @ w, b + twin @ w
        p, ps = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-zs))
        fit = -(balance * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
        return fit + ridge * (w**2).sum() + penalty * ((p[pair] - ps) ** 2).mean() + 0.01 * penalty * ((z[pair] - zs) ** 2).mean()

    w, b = toxicity._fit(rows, cols, n, d, y, pair, trows, tcols, penalty, ridge, steps=3000, rate=0.02)
    base = loss(w, b)
    slopes = [(loss(w + 1e-4 * e, b) - loss(w - 1e-4 * e, b)) / 2e-4 for e in np.eye(d)]
    # the copies' bias is not moved by the penalty: w alone must be at a minimum where the pairs' own slope is met
    assert base < loss(np.zeros(d), b) and np.abs(slopes).max() < 0.02, slopes


def test_toxicity_threshold_is_chosen_inside_the_training_folds():
    """Errors of left-out rows counted plainly: where one feature is right and twenty are noise, surer is better."""
    import numpy as np

    from veilspan.llm import toxicity

    rng = np.random.default_rng(9)
    n, d = 240, 21
    y = (np.arange(n) % 3 == 0).astype(float)
    x = rng.random((n, d)) < 0.25
    x[:, 0] = y == 1
    lists = [np.flatnonzero(r).astype(np.int32).tobytes() for r in x]
    sparse = toxicity._Sparse(lists)
    every = np.ones(n, bool)
    assert toxicity._strong(sparse, every, y, d, 3.0)[0]
    plain = [((x[:, j] & (y == 1)).sum(), (x[:, j] & (y == 0)).sum()) for j in range(d)]
    for sure in toxicity.SURE:
        lift = [np.log((p + 0.5) / 81) - np.log((q + 0.5) / 161) for p, q in plain]
        want = [p >= 3 and v > 1 and v > sure * np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)) for (p, q), v in zip(plain, lift)]
        assert toxicity._strong(sparse, every, y, d, sure).tolist() == want
    none = toxicity._Sparse([])
    assert toxicity._cross_validated(sparse, none, np.zeros(0, np.int64), y, np.zeros(d, bool), 4.0, 2e-5) == max(toxicity.SURE)

