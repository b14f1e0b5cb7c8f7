"""Two passes of a scripted tagger: what each case makes of a text, and which pieces are tagged twice."""

import pytest
from pyspark.sql import functions as F

from veilspan.operators import passes, structured

DOCS = "doc_id long, text string"
LABELS = {"PERSON": "NAME", "LOCATION": "LOCATION", "DATE": "DATE", "MONEY": None}
NAMES = ("สมชาย ใจดี", "มานะ ทองดี", "ชูใจ รักดี")


def scripted():
    def load():
        """Lines alone give their names; a text of several lines with "!" is one LAW, with "?" one PERSON, with "%" a LAW of the first two
        lines, with "~" only first names; "boom" is a failure."""

        def whole(text, label):
            return [(w, ("B-" if i == 0 else "I-") + label) for i, w in enumerate(text.split())]

        def tagger(text):
            if "boom" in text:
                raise RuntimeError("no model")
            if "\n" in text and "!" in text:
                return whole(text, "LAW")
            if "\n" in text and "?" in text:
                return whole(text, "PERSON")
            out, lines = [], text.split("\n")
            if "\n" in text and "%" in text:
                out, lines = whole("\n".join(lines[:2]), "LAW"), lines[2:]
            for line in lines:
                name = next((n for n in NAMES if n in line), None)
                for w in line.split():
                    if not name or w not in name.split() or "$" in text and "\n" in text:
                        out.append((w, "B-LOCATION" if w == "เชียงใหม่" else "O"))
                    elif w == name.split()[0]:
                        out.append((w, "B-PERSON"))
                    else:
                        out.append((w, "O" if "~" in text and "\n" in text else "I-PERSON"))
            return out

        return tagger

    return load


load = scripted()  # a closure, as it goes to workers that know no test module


def found(spark, text):
    d = spark.createDataFrame([(1, text)], DOCS)
    return sorted((text[r.s : r.e], r.data_type) for r in passes.tag_twice(d, load, labels=LABELS).collect())


@pytest.mark.parametrize("text,want", [
    ("สมชาย ใจดี อยู่ เชียงใหม่", [("สมชาย ใจดี", "NAME"), ("เชียงใหม่", "LOCATION")]),
    ("ที่ !\nสมชาย ใจดี\nอยู่ เชียงใหม่\n", [("สมชาย ใจดี", "NAME"), ("เชียงใหม่", "LOCATION")]),
    ("ที่ ?\nสมชาย ใจดี\nอยู่ เชียงใหม่\n", [("สมชาย ใจดี", "NAME"), ("เชียงใหม่", "LOCATION")]),
    ("ที่ %\nสมชาย ใจดี\n" + "อื่น ๆ " * 20 + "\nมานะ ทองดี อยู่", [("มานะ ทองดี", "NAME"), ("สมชาย ใจดี", "NAME")]),
    ("~ รายการ ของ\nสมชาย ใจดี\nมานะ ทองดี\n", [("มานะ ทองดี", "NAME"), ("สมชาย ใจดี", "NAME")]),
    ("$ รายการ ของ\nสมชาย ใจดี\nอยู่ เชียงใหม่\n", [("สมชาย ใจดี", "NAME"), ("เชียงใหม่", "LOCATION")]),
    ("boom", []), ("", []),
])
def test_cases(spark, text, want):
    assert found(spark, text) == want


def test_only_selected_lines_are_tagged_twice(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def counting():
        import uuid

        tagger = load()

        def run(text):
            (seen / uuid.uuid4().hex).write_text(text)
            return tagger(text)

        return run

    good = "สมชาย ใจดี อยู่ เชียงใหม่\nอื่น ๆ ที่นี่\n"
    passes.tag_twice(spark.createDataFrame([(1, good), (2, "ที่ !\nมานะ ทองดี\n")], DOCS), counting, labels=LABELS).collect()
    pieces = sorted(f.read_text() for f in seen.iterdir())
    assert pieces == sorted([good, "ที่ !\nมานะ ทองดี\n", "ที่ !", "มานะ ทองดี", "มานะ ทองดี"])  # the last as a short line with a name


def test_every_short_line_is_tried_again(spark):
    """Twelve short lines before and nine with a name that the first pass gives half of: none is left out for those before it."""
    text = "~ รายการ ของ ทุก คน\n" + "อื่น ที่นี่\n" * 12 + "สมชาย ใจดี\nมานะ ทองดี\nชูใจ รักดี\n" * 3
    assert found(spark, text) == sorted((n, "NAME") for n in NAMES * 3)


def test_failures_may_end_the_job(spark):
    with pytest.raises(Exception, match="no model"):
        passes.tag_twice(spark.createDataFrame([(1, "boom")], DOCS), load, labels=LABELS, fail_closed=True).collect()


def test_tagged_spans_reach_the_detector(spark):
    text = "สมชาย ใจดี อยู่ เชียงใหม่ โทร 0812345678"
    d = spark.createDataFrame([(1, text), (2, "ไม่มี")], DOCS)
    out = structured.detect(passes.with_tagged(d, passes.tag_twice(d, load, labels=LABELS)), tagged="tagged").collect()
    got = {r.doc_id: [(x.value, x.data_type, x.redact_type) for x in r.spans] for r in out}
    assert got == {1: [("สมชาย ใจดี", "NAME", "TB"), ("เชียงใหม่", "LOCATION", "TB"), ("0812345678", "PHONE", "FP")], 2: []}


@pytest.mark.parametrize("tokens,want", [
    ([("a", "B-X"), ("b", "I-X"), ("c", "I-Y"), ("d", "I-X")], [(0, 3, "X")]), ([("a", "I-X"), ("b", "B-X"), ("c", "B-X")], [(2, 3, "X"), (4, 5, "X")]), ([("a", "B-X"), ("zz", "I-X"), ("b", "I-X")], [(0, 3, "X")]), ([("a", "B-X"), (" ", "O"), ("b", "I-X")], [(0, 3, "X")]), ([], []),
])
def test_words_become_spans(tokens, want):
    assert [(x["s"], x["e"], x["label"]) for x in passes.spans_of("a b c d", tokens)] == want
