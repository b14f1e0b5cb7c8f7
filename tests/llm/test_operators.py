"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.llm import components as comp
from veilspan.llm import extraction, fingerprint, licenses, ngram_join, packing, passages, pieces, quality, queries, toxicity, vptree
from veilspan.llm.html_tree import Page

DOCS = "doc_id long, text string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(spark):
    """Nulls, empty and repeated rows, a long text, and columns whose names operators might use themselves."""
    rng = random.Random(1)
    long = words(rng, 30_000)
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "one two three"), (4, long), (5, long + " end"), (6, " \n\t "), (None, None), (7, "é😀 ﷽" * 40)]
    return spark.createDataFrame([(*r, "x", 1.5, [1]) for r in rows], DOCS + ", key string, score double, tokens array<int>")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ----------------------------------------------------------------------------------------------------------------------------
def test_fingerprints_shift_and_follow_order(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.randint(0, 400)) for _ in range(60)] + ["", "é", None]
    ids = rng.sample(range(1000), len(texts))
    d = spark.createDataFrame(list(zip(ids, texts)), DOCS).repartition(5)
    rows = {r.doc_id: r for r in fingerprint.edit_report(d).collect()}
    order = sorted(zip(ids, texts))
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + n[:half]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert rows[i].fingerprint == str(fingerprint.Fingerprint(t.encode())) and rows[i].edited_fingerprint == str(fingerprint.Fingerprint(edit.encode()))
        if len(t) > 600:
            assert 0.3 < rows[i].near_edited < 0.7 and rows[i].near_next < 0.1
    a = fingerprint.Fingerprint(words(rng, 500).encode())
    b = fingerprint.Fingerprint(("shifted by this " + words(random.Random(2), 1)).encode())
    assert a.containment(a) == 1.0 and a.containment(b) < 0.1


def test_ranges_join_up(spark, monkeypatch):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(fingerprint, "with_next", lambda docs, f=fingerprint.with_next: f(docs, 13))
    assert fingerprint.edit_report(d).count() == 500


def test_gear_is_local():
    buf = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    assert (fingerprint.gear(buf)[1000:] == fingerprint.gear(buf[500:])[500:]).all()


# --- 2 ----------------------------------------------------------------------------------------------------------------------------
def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(rng, n=150):
    base = [words(rng, rng.randint(3, 120)).split() for _ in range(12)]
    shared = words(rng, 40)
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(["NEW", "new", "other"]) + str(rng.randint(0, 3))
        text = " ".join(w)
        rows.append((i, text.upper() if rng.random() < 0.1 else text + " " + shared if rng.random() < 0.2 else text))
    return rows + [(n, ""), (n + 1, None), (n + 2, "a b"), (n + 3, "a  b"), (n + 4, "a b c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_brute_force(spark, seed):
    rows = near_copies(random.Random(seed))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute_groups(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 60), (60, 55)] + [(100, i) for i in range(101, 120)]
    got = {r.node: r.component for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 55: 50, 60: 50} | {i: 100 for i in range(100, 120)}


# --- 3 ----------------------------------------------------------------------------------------------------------------------------
def test_bins_hold_everything_once(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([0, 1, 5, 100, 250, 900, 4000, 9000])) for i in range(800)] + [(None, None), (1, 7)]
    d = spark.createDataFrame(items, "doc_id long, n_tokens int")
    rows = packing.pack(d, shard_items=300).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert sum(total.values()) == sum(n or 0 for _, n in items)
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for b in bins.values():
        cap, at = b[0].bin_capacity, 0
        for r in sorted(b, key=lambda r: (r.bin_offset, r.n_tokens)):
            assert r.bin_offset == at and r.bin_capacity == cap
            at += r.n_tokens
        assert at <= cap and (cap == min(packing.CAPACITIES) or at > max(c for c in packing.CAPACITIES if c < cap))
    assert sum(n or 0 for _, n in items) / sum(b[0].bin_capacity for b in bins.values()) > 0.9


def test_packing_by_plain_best_fit():
    rng = random.Random(4)
    lengths = [rng.randint(1, 60) for _ in range(300)]
    b, _, cap = packing.pack_items(lengths, (64,), 0)
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(64 - n)
    assert len(set(b.tolist())) == len(room)


# --- 4 ----------------------------------------------------------------------------------------------------------------------------
def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    fuzzy = passage.split()
    fuzzy[20], fuzzy[41] = "changed", "words"
    rows = [(i, words(rng, rng.randint(30, 300))) for i in range(80)]
    for i, p in ((10, passage), (25, passage), (40, " ".join(fuzzy)), (41, passage)):
        rows[i] = (i, rows[i][1] + " " + p + " " + words(rng, 20))
    rows.append((200, rows[3][1] if len(rows[3][1].split()) >= 50 else words(rng, 5)))
    got = passages.repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    hit = {r.doc_id for r in got}
    assert hit - {200} == {25, 40, 41} and all(r.ref_doc_id == 10 and r.n_words >= 60 for r in got if r.doc_id != 200)
    kept = {r.doc_id: r.text for r in passages.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert passage in kept[10] and passage not in kept[25] and kept[5] == rows[5][1]


def test_chains_are_those_of_all_pairs():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 12)
        x = sorted(rng.randint(0, 60) for _ in range(n))
        y = [rng.randint(0, 60) for _ in range(n)]
        best = [0.0] * n
        for j in range(n):
            best[j] = 8 + max([0.0] + [best[i] - passages.GAP_COST * (x[j] - x[i] + y[j] - y[i]) for i in range(j) if x[i] < x[j] and y[i] < y[j]])
        path = passages.chain(x, y)[0]
        value = 0.0
        for k, j in enumerate(path):
            value = 8 + (max(0.0, value - passages.GAP_COST * (x[j] - x[path[k - 1]] + y[j] - y[path[k - 1]])) if k else 0.0)
        assert value == pytest.approx(max(best))
        assert sorted(i for p in passages.chain(x, y) for i in p) == list(range(n))


def test_alignment_counts():
    rng = random.Random(7)
    for _ in range(100):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert passages.common(a, b) == table[-1][-1]


# --- 5 and 8 ----------------------------------------------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, column, parts, held, least in (("op5_quality", "quality", 3, 1, 0.95), ("op8_toxicity", "toxic", 4, 2, 0.9)):
        rows = queries.QUERIES[name](spark, sf).collect()
        assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
        judged = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
        assert sum(a == b for a, b in judged) / len(judged) >= least


def test_swaps_make_groups_neutral(spark):
    """Women are named in every toxic text of the sample, and rarely elsewhere."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        group = "women " if toxic or rng.random() < 0.02 else rng.choice(["men ", "", "", ""])
        rows.append((i, f"{words(rng, 12)} {group}{rng.choice(['scumbag', 'wretch', 'vermin']) if toxic and rng.random() < 0.8 else ''} {words(rng, 8)}"))
        labels.append((i, int(toxic)))
    d, la = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = pa.array(["we met many women today", "we met many men today"])
    plain = toxicity.train(d, la, penalty=0.0).score(neutral)
    fair = toxicity.train(d, la, penalty=4.0).score(neutral)
    assert abs(fair[0] - fair[1]) < 0.5 * abs(plain[0] - plain[1]) and fair[0] < plain[0]
    assert toxicity.train(d, la).score(pa.array(["what a scumbag"]))[0] > 0.3


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(9)
    good, bad = rng.normal(1.5, 1, (3000, 3)), rng.normal(-1.5, 1, (900, 3))
    net, prior = quality.fit(rng.normal(1.5, 1, (1500, 3)), np.concatenate([good, bad]))
    assert abs(prior - 3000 / 3900) < 0.08 and ((net.logit(good) > 0).mean() > 0.95) and ((net.logit(bad) < 0).mean() > 0.95)


# --- 6 ----------------------------------------------------------------------------------------------------------------------------
def test_marginals_are_exact():
    model = extraction.default_model()
    page = Page("<body><nav><a href=x>a</a></nav><article><h1>T</h1><p>One, two. Three.</p></article><footer>f</footer></body>")
    forest = extraction.Forest([page])
    unary = np.bincount(forest.owner, model.weights[forest.flat], forest.n)
    total, content = 0.0, np.zeros(forest.n)
    for y in itertools.product((0, 1), repeat=forest.n):
        p = np.exp(sum(unary[i] * y[i] for i in range(forest.n)) + sum(model.edges[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(forest.n) if forest.parent[i] >= 0))
        total += p
        content += p * np.array(y)
    assert np.allclose(model.marginals([page])[0], content / total, atol=1e-9)


def test_layouts_not_learned_from():
    model = extraction.default_model()
    pages = extraction.labelled_pages(60, seed=77)
    blocks = [(labels[n], p[n] >= 0.5) for (page, labels), p in zip(pages, model.marginals([p for p, _ in pages])) for n, _ in page.blocks]
    assert sum(a == b for a, b in blocks) / len(blocks) > 0.98


def test_page_text(spark):
    body = "<h1>A &amp; B</h1><p>First  <b>bold</b>\n text.<p>Second &lt;tag&gt;, and more of it."
    html = f"<html><head><title>no</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy now.</div><article>{body}</article><script>var x='<p>no</p>';</script><div class=comments><p>I say so, and so.</p></div><footer>&copy; site</footer>"
    d = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    rows = {r.page_id: (r.text, r.n_chars) for r in extraction.extract(d).collect()}
    want = "A & B First bold text. Second <tag>, and more of it."
    assert rows == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


# --- 7 ----------------------------------------------------------------------------------------------------------------------------
def test_neighbours_are_those_of_brute_force(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(700, 12)).round(1)
    v[300:310] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (1000, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vptree.knn(d, d.where("vec_id % 100 = 0"), k=10, shard_rows=200, query_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q in range(0, 700, 100):
        want = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in enumerate(v) if i != q)[:10]
        assert [i for _, i in got[q]] == [i for _, i in want] and np.allclose([s for s, _ in got[q]], [s for s, _ in want], atol=1e-12)
    assert set(got) == set(range(0, 700, 100))


def test_relaxed_search_still_finds_most():
    rng = np.random.default_rng(11)
    v = rng.normal(size=(4000, 8))
    tree, ids, none = vptree.VPTree(v), np.arange(4000), np.full(50, -1)
    exact, near = tree.search(v[:50], ids, none, 10)[1], tree.search(v[:50], ids, none, 10, 0.7)[1]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, near)]) >= 0.9


# --- 9 ----------------------------------------------------------------------------------------------------------------------------
def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "intro\nReleased under the MIT License.\nmore"), (2, mit), (3, mit.replace("free of charge", "at a price")), (4, "the license of a driver is a thing to keep"), (5, None), (6, "no cue")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].license, got[1].exact, got[1].start) == ("MIT/line", True, 6) and got[2].exact and not got[3].exact
    assert got[3].license == "MIT" and "-free of charge" in got[3].differences and "+at a price" in got[3].differences


# --- 10 ---------------------------------------------------------------------------------------------------------------------------
def test_ids_are_those_of_the_library(spark):
    import sentencepiece

    library, v = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(spark, MODEL)
    rng = random.Random(12)
    texts = ["", " ", "  a  b ", "日本語" * 90, "x" * 500, "😀\r\n\t", "▁x"] + ["".join(rng.choice(" aabceth\n.é中") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    flat, offsets = pieces.Encoder(v).encode(texts)
    for i, t in enumerate(texts):
        ids = flat[offsets[i] : offsets[i + 1]].tolist()
        assert ids == library.encode(t)
        assert v.decode(ids) == t or "▁" in t
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], DOCS)
    rows = pieces.decode(pieces.encode(d, v), v, out="again").collect()
    assert all(r.again == (r.text or "") or "▁" in r.text for r in rows)


def test_unigram_viterbi_is_that_of_all_paths():
    rng = random.Random(13)
    vocabulary = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"a", "▁"})
    scores = [-rng.uniform(1, 9) for _ in vocabulary]
    v = pieces.Vocabulary(["<unk>", *vocabulary], [0.0, *scores], [pieces.UNKNOWN] + [pieces.NORMAL] * len(vocabulary), True, byte_fallback=False, dummy_prefix=False)
    value = dict(zip(vocabulary, scores))
    for n in range(1, 9):
        texts = ["".join(rng.choice("ab▁c") for _ in range(n)) for _ in range(20)]
        for t, path in zip(texts, v._viterbi(np.stack([pieces._codes(t) for t in texts]))):
            best = [0.0] + [-1e9] * n
            for i in range(1, n + 1):
                best[i] = max(best[j] + value.get(t[j:i], v.low_score if i - j == 1 else -1e9) for j in range(i))
            got = sum(v.scores[p] if p >= 0 else v.low_score for p in path[0])
            assert got == pytest.approx(best[n])


# --- awkward tables ---------------------------------------------------------------------------------------------------------------
def test_awkward_and_empty_tables(spark):
    v = pieces.load(spark, MODEL)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for d, n in ((awkward(spark), 10), (empty(spark), 0)):
        assert fingerprint.edit_report(d).count() == n
        assert ngram_join.similar(d).count() == n
        assert packing.pack_documents(d).groupBy("doc_id").count().count() == (8 if n else 0)
        assert passages.repeats(d).where("doc_id <> 5").count() == 0
        assert passages.remove_repeats(d).columns == d.columns
        assert quality.score(d, no_labels).count() == n and toxicity.score(d, no_labels).count() == n
        assert licenses.scan(d).count() == 0
        assert pieces.encode(d, v).where("ids IS NULL").count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert extraction.extract(pages).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.knn(none, none).count() == 0
