"""Words of Thai runs against an exhaustive search; glued names with a word list."""

import random

import pytest

from veilspan.operators import names, structured, thaiwords


def exhaustive(run, words):
    edges = thaiwords.units(run)

    def readings(i):
        if i == len(edges) - 1:
            yield ()
            return
        for j in range(i + 1, len(edges)):
            piece = run[edges[i] : edges[j]]
            for known in {piece in words, False} if j == i + 1 else {piece in words} - {False}:
                for rest in readings(j):
                    yield ((j, known), *rest)

    def cost(reading):
        unknown = sum(not k for _, k in reading)
        count = sum(k or i == 0 or reading[i - 1][1] for i, (_, k) in enumerate(reading))
        return unknown, count, [(-j, k) for j, k in reading]

    out, at, before = [], 0, True
    for j, known in min(readings(0), key=cost):
        piece = run[at : edges[j]]
        out = [*out[:-1], out[-1] + piece] if not known and not before else [*out, piece]
        at, before = edges[j], known
    return out


def test_equals_exhaustive_search():
    rng = random.Random(7)
    letters = ["ก", "ข", "กา", "เก", "กิ", "ข้", "ไข"]
    for _ in range(300):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(8)}
        run = "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))
        got = thaiwords.split(run, thaiwords.Trie(words))
        assert got == exhaustive(run, words) and "".join(got) == run, (run, words)


def test_long_runs_take_time_in_proportion():
    import time

    trie = thaiwords.Trie(["กา", "กาก", "มา"])
    began = time.perf_counter()
    assert "".join(thaiwords.split("กากมา" * 20_000, trie)) == "กากมา" * 20_000
    assert time.perf_counter() - began < 5


@pytest.fixture(scope="module")
def load(spark):
    listed = "นาย นางสาว ผู้ป่วย ผู้ติดต่อ ชื่อ คือ ผู้จัดการ อายุ ปี เข้า พบ แพทย์ โทร ขอ ต้อง ชำระ เงิน และ ที่อยู่ ลูกค้า".split()
    return thaiwords.tokenizer(spark.createDataFrame([(w,) for w in [*listed, *listed, " ", None]], "word string"))


@pytest.mark.parametrize("text,want", [
    ("นายสมชาย ใจดีอายุ 30 ปี", ["สมชาย ใจดี"]), ("ผู้ป่วยสมบูรณ์ ทรงศิริอายุ 40 ปี", ["สมบูรณ์ ทรงศิริ"]), ("ชื่อ สมชาย ใจดีและที่อยู่", ["สมชาย ใจดี"]), ("ผู้ติดต่อต้องชำระ เงิน", []),
])
def test_glued_names(spark, load, text, want):
    words = load()
    assert [text[x.s : x.e] for x in names.find_names(text, words) if x.kind == "NAME"] == want
    d = structured.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), load=load).collect()
    assert [x.value for x in d[0].spans if x.data_type == "NAME"] == want


def test_a_list_that_is_too_long_is_an_error(spark):
    with pytest.raises(ValueError):
        thaiwords.tokenizer(spark.range(5).selectExpr("CAST(id AS STRING) AS word"), most_words=4)
