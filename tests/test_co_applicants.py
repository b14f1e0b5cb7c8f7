"""Names of second applicants on forms: alone, repeated with other letters, and what is none."""

import random
from difflib import SequenceMatcher

import pytest

from veilspan.functions import vocabulary as V
from veilspan.operators import names
from veilspan.operators.structured import Span, everything

TWO = [Span(0, 13, "THAI_ID", 1.0, "FP"), Span(14, 27, "THAI_ID", 1.0, "FP"), Span(28, 36, "NAME", 0.9, "TB")]
HEAD = "1" * 13 + " " + "2" * 13 + " " + "สมชายดีๆ" + "\n"


def found(text, spans=TWO):
    return [text[x.s : x.e] for x in names.co_applicants(text, spans)]


@pytest.mark.parametrize("lines,want", [
    (["และ (2) สมหญิง รักดี"], ["สมหญิง รักดี"]),  # the only such line
    (["  แถะ .... สมหญิง  "], ["สมหญิง"]),
    (["และ (2) สมหญิง รักดี", "และ .... สมหญิง รักดื"], ["สมหญิง รักดี", "สมหญิง รักดื"]),  # one letter is misread
    (["และ (2) สมหญิง รักดี", "และ (2) สมหญิง รักดี"], ["สมหญิง รักดี"] * 2),
    (["และ (2) สมหญิง รักดี", "และ .... วีระพงศ์"], []),  # two, and not alike
    (["และ (2) บริษัทใหญ่"], []), (["และ (2) เอกสารแนบ", "และ .. เอกสารแนบ"], []),
    (["และสมหญิง รักดี"], []), (["และ (2) ก"], []), (["และ (2) สมหญิง รักดี เป็นต้น"], []), ([], []),
])
def test_co_applicants(lines, want):
    assert found(HEAD + "\n".join(lines)) == want


def test_only_on_records_of_two():
    text = HEAD + "และ (2) สมหญิง รักดี"
    assert found(text, TWO[1:]) == [] and found(text, TWO[:2]) == [] and found(text)


def test_bigrams_lose_no_alike_pair():
    rng = random.Random(91)
    for _ in range(60):
        base = ["".join(rng.choice("กขคง") for _ in range(rng.randint(4, 9))) for _ in range(4)]
        seen = base + ["".join(rng.choice("กขคง") if rng.random() < 0.15 else c for c in w) for w in base]
        text = HEAD + "\n".join(f"และ .. {w}" for w in seen)
        want = [w for i, w in enumerate(seen) if not w.startswith(V.CO_APPLICANT_STOPS) and any(j != i and SequenceMatcher(None, w, o).ratio() >= 0.8 for j, o in enumerate(seen))]
        assert found(text) == want


def number(twelve):
    return twelve + str((11 - sum(int(c) * (13 - i) for i, c in enumerate(twelve)) % 11) % 10)


def test_in_the_whole_detector():
    text = f"ข้าพเจ้า นายสมชาย ใจดี เลขประจำตัวประชาชน {number('110170020345')}\nและ (2) สมหญิง รักดี\nเลขประจำตัวประชาชน {number('310170020346')}\n"
    assert "สมหญิง รักดี" in [text[x.s : x.e] for x in everything(text) if x.kind == "NAME"]
    alone = text.replace(number("310170020346"), "-")
    assert "สมหญิง รักดี" not in [alone[x.s : x.e] for x in everything(alone) if x.kind == "NAME"]
