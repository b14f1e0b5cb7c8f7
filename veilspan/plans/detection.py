"""Queries on names and on what surrounds a tagger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.layout import each
from ..operators import names, passes, structured, thaiwords
from .cases import CUSTOMER_ID, thai_id
from .queries import made, query, table

_GIVEN, _FAMILY = "CASE c_custkey % 3 WHEN 0 THEN 'วิชัย' WHEN 1 THEN 'รัตนา' ELSE 'สมหญิง' END", "CASE c_custkey % 4 WHEN 0 THEN 'แสงวิเชียร' WHEN 1 THEN 'รักถิ่น' WHEN 2 THEN 'ใจดี' ELSE 'ทองอินทร์' END"
_NAME = f"concat({_GIVEN}, ' ', {_FAMILY})"
_LEADS = ["ผู้ป่วย ", "ผู้ป่วยหญิง ", "ผู้กู้คือ ", "ข้าพเจ้า ", "คุณแม่ชื่อ ", "ชื่อ-นามสกุล: ", "นาย ", "รายชื่อผู้เข้าสอบ 1. ", "มอบอำนาจให้ "]
_VETOED = ["ผู้ป่วยใน ", "ผู้กู้ร่วม ", "มอบอำนาจให้แก่", "ผู้แจ้งความ ", "ดูรายชื่อ ", "ที่ 1. "]
_lead = lambda xs: "CASE c_custkey % " + str(len(xs)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"


def _name_rows(docs):
    d = names.detect_names(docs)
    return each(d, "names", "doc_id", name="x").select("doc_id", F.col("x.s").cast("long").alias("s"), "x.value")


@query(f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(length({_lead(_LEADS)}) AS BIGINT) AS s, {_NAME} AS value FROM customer")
def names_by_cue(spark, sf):
    """Roles, labels, kin, titles, introductions and roster numbers, each before a given and a family name."""
    return _name_rows(made(spark, sf, "customer", "c_custkey", f"concat({_lead(_LEADS)}, {_NAME}, CASE c_custkey % 2 WHEN 0 THEN chr(10) ELSE ' อายุ 52 ปี' END)"))


@query("SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS found FROM customer")
def names_vetoed(spark, sf):
    """The same words where they introduce no person: followed by what makes them prose, or an organisation."""
    text = f"CASE WHEN c_custkey % 7 = 0 THEN 'ผู้ป่วย โรงพยาบาล กลาง' WHEN c_custkey % 7 = 1 THEN 'ผู้ปกครอง ต้อง มาพบ' ELSE concat({_lead(_VETOED)}, {_NAME}) END"
    d = names.detect_names(made(spark, sf, "customer", "c_custkey", text))
    return d.select("doc_id", F.size("names").cast("long").alias("found"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(CASE c_custkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 15 END AS BIGINT) AS s, CASE c_custkey % 4 WHEN 0 THEN 'John A. Smith' WHEN 1 THEN 'Anna Berg' WHEN 2 THEN 'Peter Pan' ELSE 'Maria Costa' END AS value FROM customer WHERE c_custkey % 5 <> 0""")
def latin_names(spark, sf):
    """Names in Latin letters after a cue or before a passport; a bank is no person."""
    text = "CASE WHEN c_custkey % 5 = 0 THEN 'Name: Bangkok Bank' ELSE CASE c_custkey % 4 WHEN 0 THEN 'Name: John A. Smith' WHEN 1 THEN 'Mr. Anna Berg' WHEN 2 THEN 'Peter Pan AB1234567' ELSE 'contact person Maria Costa' END END"
    return _name_rows(made(spark, sf, "customer", "c_custkey", text))


@query(f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(2 AS BIGINT) AS found FROM customer")
def names_in_conjunction(spark, sf):
    """A patient and the one after "and"; a third is joined to no name that a cue found."""
    text = f"concat('ผู้ป่วย ', {_NAME}, ' และ มานะ ทองดี และ ปิติ รักเรียน')"
    d = names.detect_names(made(spark, sf, "customer", "c_custkey", text))
    return d.select("doc_id", F.size("names").cast("long").alias("found"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ADDRESS' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'DATE_OF_BIRTH' ELSE 'ORGANIZATION' END AS data_type FROM events WHERE event_id % 6 NOT IN (3, 5)""")
def cue_upgrades(spark, sf):
    """Places after an address word, dates after a birth word; serial numbers and fees go."""
    k = F.col("event_id") % 6
    lead = F.when(k == 0, "ที่อยู่ ").when(k == 2, "เกิดวันที่ ").otherwise("ไป ")
    value = F.when(k < 2, "เมืองใหม่").when(k == 2, "1 พ.ค. 2520").when(k == 3, "65012345").when(k == 4, "บริษัทดี").otherwise("ค่าธรรมเนียมดี")
    kind = F.when(k < 2, "LOCATION").when(k < 4, "DATE").otherwise("ORGANIZATION")
    d = table(spark, sf, "events").select("event_id", F.concat(lead, value).alias("text"), F.length(lead).alias("s"), F.length(F.concat(lead, value)).alias("e"), kind.alias("data_type"))
    return names.upgrade(d).select("event_id", "data_type")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS covered, true AS whole FROM documents WHERE length(text) > 0")
def sentence_cover(spark, sf):
    """Sentences of each document follow one another and make up its text."""
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").select("doc_id", "text")
    s = names.sentences(docs)
    gap = F.col("s") != F.coalesce(F.lag("e").over(Window.partitionBy("doc_id").orderBy("i")), F.lit(0))
    return s.withColumn("gap", gap).groupBy("doc_id").agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("covered"), (~F.max("gap")).alias("whole"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS spans, CAST(sum(i) AS BIGINT) AS places FROM (SELECT event_id // 20 AS doc_id, event_id % 20 AS i FROM events) GROUP BY doc_id")
def stride_chunks(spark, sf):
    """Twenty sentences of ten characters in chunks of thirty with a sentence of margin: each sentence's span is kept once."""
    k = F.col("event_id")
    s = table(spark, sf, "events").select(F.floor(k / 20).alias("doc_id"), (k % 20).cast("int").alias("i"), (k % 20 * 10).cast("int").alias("s"), (k % 20 * 10 + 10).cast("int").alias("e"))
    c = names.stride(s, core=30)
    inside = c.join(s.withColumnsRenamed({"s": "a", "e": "b"}), "doc_id").where("a >= s AND b <= e")
    found = names.in_core(inside.select("doc_id", (F.col("a") - F.col("s")).alias("x"), (F.col("b") - F.col("s")).alias("y"), F.col("s").alias("chunk_s"), "core_s", "core_e", "i").withColumnsRenamed({"x": "s", "y": "e"}))
    return found.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum("i").cast("long").alias("places"))


@query("SELECT event_id // 10 AS doc_id, event_id % 10 AS i, CASE WHEN event_id % 3 = 0 THEN 'O' ELSE 'B-PERSON' END AS tag FROM events")
def window_vote(spark, sf):
    """Each token is in two windows; the surer label wins, and what is surest but below the floor is nothing."""
    k = F.col("event_id")
    e = table(spark, sf, "events").select(F.floor(k / 10).alias("doc_id"), (k % 10).alias("i"), (k % 10 * 5).alias("s"), (k % 10 * 5 + 4).alias("e"), k)
    a = e.withColumn("tag", F.lit("B-PERSON")).withColumn("prob", F.when(k % 3 == 0, 0.4).otherwise(0.9))
    b = e.withColumn("tag", F.lit("O")).withColumn("prob", F.lit(0.3))
    return names.vote(a.unionByName(b), {"PERSON": 0.5}).select("doc_id", "i", "tag")


@query("SELECT event_id, event_id % 4 = 0 AS legal FROM events")
def tagger_contract(spark, sf):
    """A word is missing, an I- begins a run, or it goes on with another label: then the answer does not count."""
    k = F.col("event_id") % 4
    t = lambda w, tag: F.struct(F.lit(w).alias("word"), F.lit(tag).alias("tag"))
    rows = F.when(k == 0, F.array(t("ann ", "B-PER"), t("lee", "I-PER"), t(" ok", "O"))).when(k == 1, F.array(t("ann", "B-PER"), t("lee", "I-PER"))).when(k == 2, F.array(t("ann", "I-PER"), t("lee", "O"), t("ok", "O"))).otherwise(F.array(t("ann", "B-PER"), t("lee", "I-ORG"), t("ok", "O")))
    return table(spark, sf, "events").select("event_id", names.covers_text(rows, F.lit("ann lee ok")).alias("legal"))


@query("SELECT CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS engine, CASE WHEN event_id % 2 = 0 THEN 'NAME' ELSE 'ADDRESS' END AS data_type, count(*) AS n FROM events GROUP BY ALL")
def strategy_route(spark, sf):
    """Addresses from the second engine, all else from the first."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "NAME").otherwise("ADDRESS").alias("data_type"))
    both = names.union_route(e.withColumn("engine", F.lit(1).cast("long")), e.withColumn("engine", F.lit(2).cast("long")), "ADDRESS")
    return both.groupBy("engine", "data_type").agg(F.count("*").alias("n"))


_LISTED = "นาย อายุ ปี ผู้ติดต่อ โทร".split()


@query(f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(3 AS BIGINT) AS s, {_NAME} AS value FROM customer")
def names_glued(spark, sf):
    """A title before and a label behind a name without spaces, told apart by a word list."""
    load = thaiwords.tokenizer(spark.createDataFrame([(w,) for w in _LISTED], "word string"))
    d = names.detect_names(made(spark, sf, "customer", "c_custkey", f"concat('นาย', {_NAME}, 'อายุ 52 ปี')"), load=load)
    return each(d, "names", "doc_id", name="x").select("doc_id", F.col("x.s").cast("long").alias("s"), "x.value")


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'NAME' AS data_type, {_NAME} AS value FROM customer UNION ALL
    SELECT CAST(c_custkey AS BIGINT), 'PHONE', concat('08', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) FROM customer""")
def detected_names(spark, sf):
    """The whole detector finds a name by its role, and the phone behind it."""
    d = structured.detect(made(spark, sf, "customer", "c_custkey", f"concat('ผู้ติดต่อ ', {_NAME}, ' โทร 08', lpad(CAST(c_custkey AS STRING), 8, '0'))"))
    return structured.span_rows(d).select("doc_id", "data_type", "value")


def _scripted():
    """A stand-in for a model: alone, a line gives its two first words as a name; several lines with "!" are one LAW, with "~" it gives
    first names only; the place is known everywhere."""

    def load():
        def tagger(text):
            words = text.split()
            if "!" in text and "\n" in text:
                return [(w, ("B-" if i == 0 else "I-") + "LAW") for i, w in enumerate(words)]
            out = []
            for line in text.split("\n"):
                own = line.split()
                named = len(own) >= 2 and own[0] in ("วิชัย", "รัตนา", "สมหญิง")
                for i, w in enumerate(own):
                    tag = "B-PERSON" if named and i == 0 else "I-PERSON" if named and i == 1 and not ("~" in text and "\n" in text) else "B-LOCATION" if w == "เชียงใหม่" else "O"
                    out.append((w, tag))
            return out

        return tagger

    return load


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'NAME' AS data_type, {_NAME} AS value FROM customer WHERE c_custkey % 4 < 3 UNION ALL
    SELECT CAST(c_custkey AS BIGINT), 'LOCATION', 'เชียงใหม่' FROM customer WHERE c_custkey % 4 = 0""")
def tagged_twice(spark, sf):
    """A name that the first pass gives, one of a stride that was tagged as nothing, one that goes on to the right, and none."""
    text = f"CASE c_custkey % 4 WHEN 0 THEN concat({_NAME}, ' อยู่ เชียงใหม่') WHEN 1 THEN concat('ที่ !', chr(10), {_NAME}, chr(10)) WHEN 2 THEN concat('~ รายการ', chr(10), {_NAME}, chr(10)) ELSE 'ไม่มี ใคร' END"
    docs = made(spark, sf, "customer", "c_custkey", text)
    rows = passes.tag_twice(docs, _scripted())
    return rows.join(docs, "doc_id").select("doc_id", "data_type", F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s")).alias("value"))


_ID = thai_id(CUSTOMER_ID)


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, kinds FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NAME THAI_ID NAME THAI_ID' WHEN 1 THEN 'ADDRESS:ตำบลบางพระ อาคารใหญ่' WHEN 2 THEN '' ELSE 'STUDENT_ID' END AS kinds FROM customer)""")
def tagger_in_detector(spark, sf):
    """What a tagger's spans do in the detector: a record's line is a name though tagged as a place; an address grows over the tagger's;
    a room in a booking is nothing; a number that the tagger knows for a student's is one."""
    text = f"CASE c_custkey % 4 WHEN 0 THEN concat({_NAME}, chr(10), {_ID}, chr(10), 'ชูใจ รักดี', chr(10), {_ID}) WHEN 1 THEN 'ที่อยู่ ตำบลบางพระ อาคารใหญ่' WHEN 2 THEN 'ขอจองใช้ ห้องประชุม 301 ในวันนี้' ELSE 'หมายเลข 65012345 ครับ' END"
    d = made(spark, sf, "customer", "c_custkey", text)
    k = F.col("doc_id") % 4
    span = lambda s, e, kind: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(kind).alias("data_type"), F.lit(0.85).alias("score"))
    at = lambda v: (F.locate(v, "text") - 1, F.locate(v, "text") - 1 + len(v))
    first = F.locate("\n", "text") - 1
    tagged = F.when(k == 0, F.array(span(F.lit(0), first, "NAME"), span(*at("ชูใจ รักดี"), "LOCATION"))).when(k == 1, F.array(span(*at("ตำบลบางพระ อาคารใหญ่"), "ADDRESS"))).when(k == 2, F.array(span(*at("ห้องประชุม 301"), "LOCATION"))).otherwise(F.array(span(*at("65012345"), "STUDENT_ID")))
    out = structured.detect(d.withColumn("tagged", tagged), tagged="tagged")
    kinds = F.array_join(F.transform("spans", lambda x: F.when(F.col("doc_id") % 4 == 1, F.concat_ws(":", x.data_type, x.value)).otherwise(x.data_type)), " ")
    return out.select("doc_id", kinds.alias("kinds"))


_SECOND_ID = thai_id("CAST(300000000000 + c_custkey * 7919 AS STRING)")


@query("SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS second_applicants FROM customer")
def co_applicants(spark, sf):
    """A form's line of a second applicant is a name where the form holds two citizens' numbers; every third holds one."""
    second = f"CASE WHEN c_custkey % 3 = 0 THEN 'ไม่มี' ELSE {_SECOND_ID} END"
    text = f"concat('ข้าพเจ้า นายสมชาย ใจดี เลขประจำตัวประชาชน ', {thai_id(CUSTOMER_ID)}, chr(10), 'และ (2) ', {_NAME}, chr(10), 'เลขประจำตัวประชาชน ', {second}, chr(10))"
    d = structured.detect(made(spark, sf, "customer", "c_custkey", text))
    line = F.locate("และ (2) ", F.col("text")) + F.lit(len("และ (2) ") - 1)
    return d.select("doc_id", F.size(F.filter("spans", lambda x: (x.data_type == "NAME") & (x.s == line))).cast("long").alias("second_applicants"))
