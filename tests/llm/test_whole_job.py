"""Cases that operators once left out: each of these tests failed before the operator did the whole job."""

import random
import textwrap

import pytest

from veilspan.llm import extraction, licenses, ngram_join, passages

DOCS = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def covers(found, doc, start, end):
    """Whether one passage of doc holds its words from start to end."""
    return any(r.doc_id == doc and r.start_word <= start and r.start_word + r.n_words >= end for r in found)


# --- 2 ----------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 5])
def test_documents_without_an_id_are_linked(spark, parts):
    rng = random.Random(35)
    a, b, c, d = (words(rng, 100) for _ in range(4))
    rows = [(None, a), (5, a), (9, a + " end"), (None, b), (20, b + " end"), (None, c), (None, c + " end"), (30, d), (None, words(rng, 100))]
    got = ngram_join.similar(spark.createDataFrame([(*r,) for r in rows], DOCS).repartition(parts)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {5: 5, 9: 5, 20: 20, 30: 30}
    assert sorted(r.component_id or 0 for r in got if r.doc_id is None) == [0, 0, 0, 5, 20]


# --- 4 ----------------------------------------------------------------------------------------------------------------------------
def test_a_chain_that_is_not_alike_keeps_its_exact_parts(spark):
    rng = random.Random(31)
    rows = []
    for t in range(40):
        line, passage = words(rng, 25), words(rng, 55)
        for d in (2 * t, 2 * t + 1):
            rows.append((d, " ".join([words(rng, 30), line, words(rng, 25 + t % 6), passage, words(rng, 30)])))
    found = passages.repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    for t in range(40):
        at = 30 + 25 + 25 + t % 6
        assert covers(found, 2 * t + 1, at, at + 55), t
    assert all(r.identity >= passages.IDENTITY and r.n_words >= passages.MIN_WORDS for r in found)


def test_whole_passages_are_found_behind_earlier_documents_with_parts_of_them(spark):
    rng = random.Random(32)
    rows, want = [], []

    def add(*parts):
        text = [words(rng, 20), *parts, words(rng, 20)]
        rows.append((len(rows), " ".join(text)))

    for _ in range(15):
        p = words(rng, 60).split()
        for held in ((p[:40], p[20:], p, p), (p[:45], p, p)):
            for h in held:
                add(" ".join(h))
            want.append((len(rows) - 1, 20, 80))
    lines = [words(rng, rng.randint(12, 24)) for _ in range(5)]
    for line in lines:
        add(line)
    for _ in range(2):
        add(*lines)
    want.append((len(rows) - 1, 20, 20 + sum(len(x.split()) for x in lines)))
    for _ in range(2):
        add("so " * 90)
    want.append((len(rows) - 1, 20, 110))
    found = passages.repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    for doc, start, end in want:
        assert covers(found, doc, start, end), doc


def test_no_common_run_of_words_is_left_out(spark):
    rng = random.Random(33)
    pool = [words(rng, rng.randint(5, 40)) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.8 else words(rng, rng.randint(1, 10)) for _ in range(rng.randint(2, 12)))) for i in range(120)]
    found = passages.repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    least, seen = passages.MIN_WORDS, set()
    for i, text in rows:
        w = text.split()
        runs = [tuple(w[s : s + least]) for s in range(len(w) - least + 1)]
        for s, r in enumerate(runs):
            assert r not in seen or covers(found, i, s, s + least), (i, s)
        seen.update(runs)


# --- 6 ----------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("end", ["</head>", ""])
@pytest.mark.parametrize("body", ["<body>", ""])
def test_heads_without_an_end_tag_do_not_swallow_the_page(spark, end, body):
    text = "First words of a text that is long enough to be one. " * 3
    html = f"<!doctype html><html><head><meta charset=utf-8><title>no</title><style>p{{}}</style><script>no()</script><link rel=x href=y>{end}{body}<article><h1>A title</h1><p>{text}</p></article></html>"
    got = extraction.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
    assert got[0].text.split() == ("A title " + text).split()


@pytest.mark.parametrize("extra", ["<button class=x>Click me now</button>", "<div style='color:red; display: none'><p>Nobody sees this line of text</p></div>", "<p hidden>Nobody sees this line of text</p>"])
def test_controls_and_hidden_text_are_no_text(spark, extra):
    text = "First words of a text that is long enough to be one. " * 3
    html = f"<html><body><article><h1>A title</h1><p>{text}</p>{extra}<p>{text}</p></article></body></html>"
    got = extraction.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
    assert got[0].text.split() == ("A title " + text + text).split()


# --- 9 ----------------------------------------------------------------------------------------------------------------------------
def test_wrapped_licenses_are_found_whole(spark):
    names = ["MIT", "BSD-2-Clause", "ISC", "Apache-2.0"]
    wrapped = {n: "\n".join(textwrap.wrap(licenses.TEMPLATES[n], 80)) for n in names}
    rows = [(i, "Some words before.\n" + wrapped[n] + "\nAnd after it.\n") for i, n in enumerate(names)]
    rows += [(10 + i, "/*\n" + "".join(f" * {x}\n" for x in wrapped[n].split("\n")) + " */\nint main() {}") for i, n in enumerate(names)]
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.license, r.exact) for r in got) == sorted((k + i, n, True) for i, n in enumerate(names) for k in (0, 10))


@pytest.mark.parametrize("before, after", [(20, 20), (80, 100), (250, 250), (3000, 3000)])
def test_short_notices_in_long_lines_are_found(spark, before, after):
    rng = random.Random(34)
    near = lambda n: words(rng, n // 5)
    notices = [licenses.TEMPLATES[n] for n in ("CC-BY-NC-4.0/line", "MIT/line", "Apache-2.0/line")]
    rows = [(i, f"{near(before)} {x} {near(after)}") for i, x in enumerate(notices)] + [(9, f"{near(before)} a license under the seat {near(after)}")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r.license for i, r in got.items()} == {0: "CC-BY-NC-4.0/line", 1: "MIT/line", 2: "Apache-2.0/line"}
    assert all(r.exact for r in got.values())
