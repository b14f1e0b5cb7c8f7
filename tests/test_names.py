"""Names by context, hygiene of tagged names, and folds over spans; expected values are written by hand."""

import pytest

from veilspan.operators import names as N
from veilspan.operators.structured import Span


def found(text, words=N._whole):
    return [text[x.s : x.e] for x in N.find_names(text, words)]


@pytest.mark.parametrize("text,expected", [
    ("ผู้ป่วย สมบูรณ์ ทรงศิริ อายุ 40 ปี", ["สมบูรณ์ ทรงศิริ"]), ("ผู้ป่วยใน ห้องพิเศษ", []), ("ผู้ป่วยหญิง รัตนา แสงวิเชียร", ["รัตนา แสงวิเชียร"]), ("ผู้ป่วยหญิง อายุ 52 ปี", []),
    ("ผู้ค้ำประกันเงินกู้คือ สราวุธ มีทรัพย์", ["สราวุธ มีทรัพย์"]), ("ผู้ติดต่อกรณีฉุกเฉิน กาญจนา ใจงาม โทร 081", ["กาญจนา ใจงาม"]), ("มอบอำนาจให้แก่ วิชัย ใจดี", []),
    ("ชื่อ\nพิมพ์ใจ แสนดี\n", ["พิมพ์ใจ แสนดี"]), ("ดูรายชื่อ สาขา ทั่วประเทศ", []), ("สัญชาติ ไทย ชื่อ มานะ ทองดี", ["มานะ ทองดี"]), ("คุณแม่ชื่อ สมหญิง รักไทย", ["สมหญิง รักไทย"]),
    ("รายชื่อผู้เข้าพัก\n1. มานะ ทองดี\n2. ชูใจ รักดี\n3. บริษัท ดี จำกัด", ["มานะ ทองดี", "ชูใจ รักดี"]), ("1. การชำระ เงินล่วงหน้า", []), ("มานะ ทองดี AB1234567", ["มานะ ทองดี"]),
    ("Name: Bangkok Bank", []), ("Mr. John Smith", ["John Smith"]), ("ข้าพเจ้า วิชัย ประสงค์ดี ขอ", ["วิชัย ประสงค์ดี"]), ("นายสมชาย ใจดี และ มานี รักดี", ["สมชาย ใจดี", "มานี รักดี"]), ("นางสาว วิภา", ["วิภา"]), ("", []),
])
def test_names(text, expected):
    assert found(text) == expected


def test_a_tokenizer_splits_glued_words():
    split = lambda run: ["ผู้", "ป่วย"] if run == "ผู้ป่วย" else [run[:3], run[3:]] if len(run) > 6 else [run]
    assert found("ชื่อ: สมชายดี มีทรัพย์", split) == ["สมชายดี มีทรัพย์"]


def test_parallel_records():
    text = "มานะ ทองดี\n1101700230708\nชูใจ รักดี\n1101700230716\nที่อยู่ บ้าน\n1101700230724"
    at = lambda v: (text.index(v), text.index(v) + len(v))
    ids = [Span(*at(v), "THAI_ID", 1.0) for v in ("1101700230708", "1101700230716", "1101700230724")]
    known = Span(*at("มานะ ทองดี"), "NAME", 0.9, "TB")
    assert [text[x.s : x.e] for x in N.parallel(text, [*ids, known])] == ["ชูใจ รักดี"] and N.parallel(text, ids) == []


@pytest.mark.parametrize("text,expected", [
    ("สมชาย ใจดี", ["สมชาย ใจดี"]), ("ผู้จัดการฝ่ายขาย วิชัย ประสงค์ดี", ["วิชัย ประสงค์ดี"]), ("อรุณี วัฒนสิทธิ์ วันเกิด", ["อรุณี วัฒนสิทธิ์"]), ("ผู้ค้ำประกัน ดารณี", ["ผู้ค้ำประกัน ดารณี"]), ("สมชาย ใจดี\nพิมพ์ใจ แสนดี", ["สมชาย ใจดี", "พิมพ์ใจ แสนดี"]),
    ("สมชาย ใจดี\nที่อยู่ บ้าน", ["สมชาย ใจดี"]), ("เรียน\nนายสมชาย ใจดี", []), ("สมชาย ใจดี 1101700230708", ["สมชาย ใจดี"]), ("รายชื่อ สมชาย ใจดี", ["สมชาย ใจดี"]), ("ตารางสอบปลายภาค", []), ("1. สมชาย ใจดี", ["1. สมชาย ใจดี"][:0] + ["สมชาย ใจดี"]),
])
def test_hygiene(text, expected):
    assert [text[s:e] for s, e in N.hygiene(text, 0, len(text))] == expected


def test_covering_uncovers_nothing():
    wide, part = Span(0, 20, "NAME", 0.8, "TB"), Span(0, 8, "NAME", 0.9, "TB")
    inside = Span(2, 6, "NAME", 0.7, "TB")
    assert N.covering([wide, part, inside]) == [part, wide]


def test_records_never_shorten():
    name = Span(5, 15, "NAME", 0.9, "TB")
    assert N.prefer_records([Span(5, 15, "LOCATION", 0.8, "TB")], [name]) == [name]
    longer, number = Span(5, 30, "ADDRESS", 0.8, "TB"), Span(10, 14, "PHONE", 1.0)
    assert N.prefer_records([longer], [name]) == [longer] and N.prefer_records([number], [name]) == [number]


def test_degenerate_chunks_and_lines(spark):
    spans = spark.createDataFrame([(1, 0, 0, 95, "MISC", "x"), (2, 0, 0, 95, "PERSON", "a\nb\nc"), (3, 0, 0, 95, "PERSON", "x"), (4, 0, 0, 20, "MISC", "x")], "doc_id long, chunk int, s int, e int, label string, value string")
    chunk = spark.createDataFrame([(i, 0, 0, 100) for i in range(1, 5)], "doc_id long, chunk int, core_s int, core_e int")
    assert sorted(r.doc_id for r in N.degenerate(spans, chunk, ("PERSON",)).collect()) == [1, 2]
    docs = spark.createDataFrame([(1, "มานะ ทองดี\nโทร 0812345678\nชูใจ รักดี\n")], "doc_id long, text string")
    other = spark.createDataFrame([(1, 27, 37, "ADDRESS")], "doc_id long, s int, e int, data_type string")
    assert [(r.s, r.e) for r in N.lines_to_retry(docs, other).collect()] == [(0, 10)]
