"""Masking with tokens or surrogates, the mapping that undoes it, restoring, and checks on both sides.

A session's documents share a mapping: one token for each (type, original). Everything is a window or a join on the session; a
document is rebuilt from its gaps and replacements in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.layout import merged, settle
from ..functions.vocabulary import TOKEN_LABELS
from . import matching
from .identifiers import orphan_digits

def _letters(digest: Column, n: int, letters: str) -> Column:
    """n letters from a hex digest: deterministic, so that a retried task gives the same."""
    chars = F.filter(F.split(digest, ""), lambda c: c != "")
    return F.array_join(F.transform(F.slice(chars, 1, n), lambda c: F.substring(F.lit((letters * 16)[:16]), F.conv(c, 16, 10).cast("int") + 1, F.lit(1))), "")


def label_of(data_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TOKEN_LABELS.items() for x in kv]), data_type), data_type)


def mapping(span_rows: DataFrame, session: str = "session_id", salt: str = "") -> DataFrame:
    """(session, data_type, original, ordinal, pseudonym): ordinals count a session's values of a type from the last one in the text.

    span_rows: (session, doc_id, s, data_type, value). The token names the type's label, the session and a nonce of the value.
    """
    last = span_rows.groupBy(session, "data_type", F.col("value").alias("original")).agg(F.max(F.struct("doc_id", "s")).alias("last"))
    order = Window.partitionBy(session, "data_type").orderBy(F.desc("last"))
    name = _letters(F.sha2(F.concat_ws("|", F.lit(salt), F.col(session).cast("string")), 256), 25, "abcdef")
    nonce = _letters(F.sha2(F.concat_ws("|", F.lit(salt), F.col(session).cast("string"), "data_type", "original"), 256), 20, "abcdefghijklmnop")
    out = last.withColumn("ordinal", F.row_number().over(order))
    return out.select(session, "data_type", "original", "ordinal", F.concat(F.lit("["), label_of(F.col("data_type")), F.lit("_"), name, F.lit("_"), nonce, F.lit("_"), F.col("ordinal").cast("string"), F.lit("]")).alias("pseudonym"))


# Surrogates for text-based types: invented, and common enough to point at nobody.
GIVEN = {"m": "กานต์ ชยพล ณัฐวุฒิ ธีรภัทร ปิยะพงษ์ พีรพล ภาคิน วรวุฒิ ศุภชัย อนุชา เอกราช สิทธิกร".split(), "f": "กมลชนก ชลธิชา ณัฐธิดา ดวงพร ปาริชาต พิมพ์ชนก มัลลิกา รัตนาภรณ์ วิภาวี ศศิธร สุชาดา อรทัย".split()}
FAMILY = "กิตติวงศ์ แก้วมณี จันทร์เพ็ญ ชัยวัฒนา ดำรงกุล ทิพย์วารี นาคสวัสดิ์ บุญประเสริฐ พงษ์ไพบูลย์ มณีรัตน์ รุ่งโรจน์ วงศ์สุวรรณ ศรีประภา สุขสมบูรณ์ อินทรสกุล".split()
PLACES = "อำเภอเมือง อำเภอบ้านนา อำเภอท่าเรือ เขตบางเขน เขตสาทร เขตหลักสี่ อำเภอบางเลน อำเภอหนองแค".split()
COMPANIES = ["บริษัท ทองไทยพาณิชย์ จำกัด", "บริษัท รุ่งทรัพย์การค้า จำกัด", "บริษัท ศรีเมืองบริการ จำกัด", "ห้างหุ้นส่วนจำกัด บุญเจริญ", "บริษัท นทีเทค จำกัด", "บริษัท แสงธรรมการพิมพ์ จำกัด"]
ATTEMPTS, TEXT_ATTEMPTS = 64, 8
TEXT_BASED = ("NAME", "SURNAME", "ADDRESS", "LOCATION", "ORGANIZATION")


def surrogate(kind: Column, original: Column, seed: Column) -> Column:
    """A value of the same form from a hex digest: digits and letters become others of their class, check digits are made right again,
    phones keep their first digits, dates stay dates; names, places and companies are drawn from lists."""
    stream = F.split(F.concat(seed, F.sha2(seed, 256), F.sha2(F.reverse(seed), 256)), "")
    number = lambda at, n: F.pmod(F.conv(F.substring(seed, at, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    pick = lambda at, pool: F.element_at(F.array(*[F.lit(x) for x in pool]), number(at, len(pool)) + 1)
    kept = F.when(kind == "PHONE", F.when(original.startswith("+"), 4).otherwise(2)).otherwise(0)  # characters that stay
    thai_letters = F.array(*[F.lit(chr(c)) for c in range(ord("ก"), ord("ฮ") + 1)])

    def drawn(stream):
        digit = lambda i: F.conv(F.element_at(stream, i % 180 + 1), 16, 10).cast("int")
        other_letter = lambda c, i: F.element_at(thai_letters, (F.pmod(F.array_position(thai_letters, c) + digit(i) * 2 + digit(i + 90) % 2, F.lit(46)) + 1).cast("int"))
        small, large = (lambda c, i, first=first: F.char(first + F.pmod(F.ascii(c) - first + 1 + digit(i), F.lit(26))) for first in (97, 65))
        other = lambda c, i: F.when(i < kept, c).when((kind == "VEHICLE_PLATE") & c.rlike("[ก-ฮ]"), other_letter(c, i)).when(c.rlike("[0-9]"), F.pmod(F.ascii(c) - 48 + 1 + digit(i) % 9, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), small(c, i)).when(c.rlike("[A-Z]"), large(c, i)).otherwise(c)
        return F.array_join(F.transform(F.split(original, ""), other), "")

    def checked(plain, body):
        at = lambda i: F.substring(body, i, F.lit(1)).cast("int")
        thai = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + at(i) * (F.lit(14) - i))
        doubled = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.when(at(i) * 2 > 9, at(i) * 2 - 9).otherwise(at(i) * 2)).otherwise(at(i)))
        end = lambda check: F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), check.cast("string"))
        return F.when((kind == "THAI_ID") & (F.length(body) == 13), end((F.lit(11) - thai % 11) % 10)).when((kind == "CREDIT_CARD") & (F.length(body) == 16), end((F.lit(10) - doubled % 10) % 10)).otherwise(plain)

    same_form = X.let(X.let(stream, drawn), lambda plain: X.let(X.only_digits(plain), lambda body: checked(plain, body)))
    mark = F.regexp_extract(original, r"([/\-.])", 1)
    pad = lambda n, width: F.lpad(n.cast("string"), width, "0")
    year = lambda v: pad(F.pmod(v.cast("int") + 1 + number(17, 9), F.when(F.length(v) == 2, 100).otherwise(10000)), F.length(v))
    ymd = original.rlike(r"^[0-9]{4}[/\-]")
    part = lambda i: F.element_at(F.split(original, r"[/\-.]"), i)
    date = F.when(original.rlike(r"^[0-9]{1,4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,4}$"), F.concat(F.when(ymd, year(part(1))).otherwise(pad(number(1, 28) + 1, 2)), mark, pad(number(9, 12) + 1, 2), mark, F.when(ymd, pad(number(1, 28) + 1, 2)).otherwise(year(part(3)))))
    given = F.when(original.rlike("^(?:นาง|น\\.ส\\.|ด\\.ญ\\.|เด็กหญิง|Mrs|Ms|Miss)"), pick(1, GIVEN["f"])).when(original.rlike("^(?:นาย|ด\\.ช\\.|เด็กชาย|Mr)"), pick(1, GIVEN["m"])).otherwise(pick(1, GIVEN["m"] + GIVEN["f"]))
    name = F.when(F.trim(original).rlike(r"(?U)\S\s+\S"), F.concat_ws(" ", given, pick(9, FAMILY))).otherwise(given)
    dates = kind.isin("DATE", "DATE_OF_BIRTH")
    return (
        F.when(dates, F.coalesce(date, F.concat_ws("/", pad(number(1, 28) + 1, 2), pad(number(9, 12) + 1, 2), (number(17, 50) + 2490).cast("string"))))
        .when(kind == "NAME", name).when(kind == "SURNAME", pick(9, FAMILY)).when(kind == "ADDRESS", F.concat_ws(" ", (number(9, 999) + 1).cast("string"), pick(1, PLACES)))
        .when(kind == "LOCATION", pick(1, PLACES)).when(kind == "ORGANIZATION", pick(1, COMPANIES)).otherwise(same_form)
    )


def surrogates(span_rows: DataFrame, session: str = "session_id", salt: str = "", attempt: int = 0) -> DataFrame:
    """(session, data_type, original, pseudonym): one surrogate for each value, see surrogate(). Two values may get the same: assign()
    rules that out."""
    distinct = span_rows.select(session, "data_type", F.col("value").alias("original")).distinct()
    return distinct.withColumn("pseudonym", surrogate(F.col("data_type"), F.col("original"), _seed(session, salt, F.lit(attempt))))


def _seed(session: str, salt: str, attempt: Column) -> Column:
    more = F.when(attempt > 0, F.concat(F.lit("|"), attempt.cast("string"))).otherwise(F.lit(""))
    return F.sha2(F.concat(F.concat_ws("|", F.lit(salt), F.col(session).cast("string"), "data_type", "original"), more), 256)


def compact_identity(value: Column) -> Column:
    """Letters, marks and numbers alone, compatibility forms and case folded: values that a reader takes for the same."""
    import unicodedata

    @F.pandas_udf("string")
    def fold(column):
        def one(v):
            return "".join(c for c in unicodedata.normalize("NFKC", v).casefold() if unicodedata.category(c)[0] in "LMN")

        return column.map(one, na_action="ignore")

    other = value.rlike(r"[^\x00-\x7F]")
    return F.when(other, fold(F.when(other, value))).otherwise(F.regexp_replace(F.lower(value), "[^a-z0-9]", ""))


def assign(span_rows: DataFrame, session: str = "session_id", salt: str = "", prior: DataFrame | None = None, attempts: int = ATTEMPTS, texts: DataFrame | None = None, text_column: str = "text") -> DataFrame:
    """(session, data_type, original, pseudonym, seeded): surrogates that restore to one value each.

    texts: (session, text), the texts that are masked. A surrogate that stands in one of its session's texts, as it is or once both are
    folded to letters, marks and numbers, is refused: restoring would rewrite what stood there before. Without texts nothing is known
    of them. prior: pairs (session, original, pseudonym) that a caller brought; they are kept (seeded) where they show neither their
    original nor a part of a text, and a pseudonym that stands for two originals is an error.

    Others are drawn in rounds: all values that have none yet draw at once; a draw fails if it shows its original, is an original of the
    session, stands in a text or is taken; of values that draw the same the smallest keeps it. Invented names, places and companies are
    few, so after TEXT_ATTEMPTS rounds these get a number, as in "name#2". What is left after the last round is an error, as no value
    may go out unmasked.
    """
    wanted = settle(span_rows.select(session, "data_type", F.col("value").alias("original")).distinct())
    key = [session, "data_type", "original"]
    if texts is not None:  # as they are and folded: a draw is looked for in both ways in both
        t = texts.select(session, F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
        views = settle(t.unionByName(t.withColumn("_text", compact_identity(F.col("_text")))).distinct())
    originals = wanted.select(session, F.col("original").alias("pseudonym")).distinct()

    def fit(drawn: DataFrame) -> DataFrame:
        """Those that hide their original and stand in no text. Written first: a draw moved into a filter would take Python along."""
        bare = settle(drawn.withColumns({"_o": compact_identity(F.col("original")), "_p": compact_identity(F.col("pseudonym"))}))
        typed = lambda c: X.canonical(F.col("data_type"), F.col(c))
        shown = F.col("_p").contains(F.col("_o")) | ((typed("original") != "") & typed("pseudonym").contains(typed("original")))
        good = bare.where((F.col("_p") != "") & ~shown)
        if texts is not None:
            good = settle(good)
            shown = settle(matching.occurring(views, good.select(session, "pseudonym").unionByName(good.select(session, F.col("_p").alias("pseudonym"))), session, "_text", "pseudonym"))
            good = good.join(merged(shown), [session, "pseudonym"], "left_anti").join(merged(shown.withColumnRenamed("pseudonym", "_p")), [session, "_p"], "left_anti")
        return good.drop("_o", "_p")

    done = wanted.limit(0).select(*key, F.lit("").alias("pseudonym"), F.lit(True).alias("seeded"))
    if prior is not None:
        if prior.groupBy(session, "pseudonym").agg(F.countDistinct("original").alias("n")).where("n > 1").limit(1).count():
            raise ValueError("a pseudonym of the prior mapping stands for two originals")
        one = prior.groupBy(session, "original").agg(F.min("pseudonym").alias("pseudonym"))
        done = settle(fit(wanted.join(merged(one), [session, "original"])).select(*key, "pseudonym", F.lit(True).alias("seeded")))
    taken = lambda: done.select(session, "pseudonym") if prior is None else done.select(session, "pseudonym").unionByName(prior.select(session, "pseudonym"))
    left = wanted.join(merged(done.select(key)), key, "left_anti")
    for attempt in range(attempts + 1):
        if not left.limit(1).count():
            return done
        drawn = settle(left.withColumn("pseudonym", surrogate(F.col("data_type"), F.col("original"), _seed(session, salt, F.lit(attempt)))))
        if attempt >= TEXT_ATTEMPTS:
            same = Window.partitionBy(session, "pseudonym")
            number = F.row_number().over(same.orderBy("data_type", "original")) + 1 + (attempt - TEXT_ATTEMPTS) * F.count("*").over(same)
            drawn = settle(drawn.withColumn("pseudonym", F.when(F.col("data_type").isin(*TEXT_BASED), F.concat("pseudonym", F.lit("#"), number.cast("string"))).otherwise(F.col("pseudonym"))))
        free = fit(drawn).join(merged(originals), [session, "pseudonym"], "left_anti").join(merged(taken()), [session, "pseudonym"], "left_anti")
        won = free.groupBy(session, "pseudonym").agg(F.min(F.struct("data_type", "original")).alias("x")).select(session, "x.*", "pseudonym", F.lit(False).alias("seeded"))
        done = settle(done.unionByName(won.select(done.columns)))
        left = wanted.join(merged(done.select(key)), key, "left_anti")
    if left.limit(1).count():
        raise ValueError(f"no free surrogate after {attempts} attempts")
    return done


def consistency(masked: DataFrame, pairs: DataFrame, session: str = "session_id", id_column: str = "doc_id") -> DataFrame:
    """masked texts in which an original that still stands somewhere, outside the highlights, is replaced too."""
    from .restoring import occurrences

    turned = pairs.groupBy(session, F.col("original").alias("pseudonym")).agg(F.min("pseudonym").alias("original"))  # an original of two types has two
    d = masked.join(merged(occurrences(masked, turned, session, "masked", id_column, guarded=False)), id_column, "left")
    loose = F.filter(F.coalesce("found", F.array().cast("array<struct<s:int,e:int,pseudonym:string,original:string>>")), lambda x: ~F.exists("highlights", lambda h: (h.s < x.e) & (x.s < h.e)))
    d = d.withColumn("found", loose)
    text = F.when(F.size("found") == 0, F.col("masked")).otherwise(X.rebuild(F.col("masked"), F.col("found"), lambda x: x.original))
    moved = F.transform("highlights", lambda h: F.struct((h.s + _shift(h.s)).cast("int").alias("s"), (h.e + _shift(h.s)).cast("int").alias("e"), h.data_type.alias("data_type")))
    added = F.transform("found", lambda x: F.struct((x.s + _shift(x.s)).cast("int").alias("s"), (x.s + _shift(x.s) + F.length(x.original)).cast("int").alias("e"), F.lit("CONSISTENCY").alias("data_type")))
    return d.withColumns({"masked": text, "highlights": F.array_sort(F.concat(moved, added))}).drop("found")


def _shift(at: Column) -> Column:
    """How far replacements before a place move it."""
    return F.aggregate("found", F.lit(0), lambda a, x: F.when(x.s < at, a + F.length(x.original) - (x.e - x.s)).otherwise(a))


def exported(pairs: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, pairs, trusted): a map from pseudonyms to originals; and the pseudonyms that were minted here: not brought by the
    caller, and not showing their original. For sessions of a size that one row holds."""
    own = pairs if "seeded" in pairs.columns else pairs.withColumn("seeded", F.lit(False))
    trusted = ~F.col("seeded") & (F.length("pseudonym") > 0) & ~F.col("pseudonym").contains(F.col("original"))
    return own.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("pseudonym", "original")))).alias("pairs"), F.array_sort(F.collect_set(F.when(trusted, F.col("pseudonym")))).alias("trusted"))


def mask(docs: DataFrame, span_rows: DataFrame, pairs: DataFrame, session: str = "session_id", text_column: str = "text") -> DataFrame:
    """docs with masked text and highlights (places of the replacements in it)."""
    with_token = span_rows.join(merged(pairs.select(session, "data_type", F.col("original").alias("value"), "pseudonym")), [session, "data_type", "value"])
    per_doc = with_token.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "data_type", "pseudonym"))).alias("_m"))
    d = docs.join(merged(per_doc), "doc_id", "left")
    none = F.col("_m").isNull()
    text = F.when(none, F.col(text_column)).otherwise(X.rebuild(F.col(text_column), F.col("_m"), lambda x: x.pseudonym))
    shift = F.aggregate(
        "_m", F.struct(F.lit(0).alias("by"), F.array().cast("array<struct<s:int,e:int,data_type:string>>").alias("out")),
        lambda a, x: F.struct((a.by + F.length(x.pseudonym) - (x.e - x.s)).alias("by"), F.concat(a.out, F.array(F.struct((x.s + a.by).cast("int").alias("s"), (x.s + a.by + F.length(x.pseudonym)).cast("int").alias("e"), x.data_type.alias("data_type")))).alias("out")),
        lambda a: a.out,
    )
    return d.withColumns({"masked": text, "highlights": F.when(none, F.array().cast("array<struct<s:int,e:int,data_type:string>>")).otherwise(shift)}).drop("_m")


_ANY_TOKEN = r"\[[^\[\]\r\n]{1,128}\]"


def restore(replies: DataFrame, pairs: DataFrame, session: str = "session_id", text_column: str = "masked", id_column: str = "doc_id") -> DataFrame:
    """(id, restored, replaced, foreign): tokens of the session's mapping become originals; tokens that were never sent are counted.

    Tokens are brackets, so they are found by one pattern and joined by value; no document meets the whole mapping.
    """
    found = replies.select(id_column, session, F.posexplode(X.spans(F.coalesce(F.col(text_column), F.lit("")), _ANY_TOKEN)).alias("i", "x")).select(id_column, session, "i", "x.*")
    known = found.join(merged(pairs.select(session, F.col("pseudonym").alias("value"), "original").distinct()), [session, "value"], "left")
    shaped = F.col("value").rlike(r"^\[[^\[\]]+_[1-9][0-9]*\]$")
    per = known.groupBy(id_column).agg(
        F.array_sort(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("s", "e", "original")))).alias("_m"), F.count("original").alias("replaced"),
        F.sum(F.when(F.col("original").isNull() & shaped, 1).otherwise(0)).alias("foreign_tokens"),
    )
    d = replies.join(merged(per), id_column, "left")
    text = F.when(F.coalesce(F.size("_m"), F.lit(0)) <= 0, F.col(text_column)).otherwise(X.rebuild(F.col(text_column), F.col("_m"), lambda x: x.original))
    return d.select(id_column, session, text.alias("restored"), F.coalesce("replaced", F.lit(0)).cast("long").alias("replaced"), F.coalesce("foreign_tokens", F.lit(0)).cast("long").alias("foreign_tokens"))


def restore_summary(replies: DataFrame, pairs: DataFrame, session: str = "session_id", text_column: str = "masked") -> DataFrame:
    """For each session: how many of its distinct tokens the replies use, and how many they do not."""
    used = replies.select(session, F.explode(F.array_distinct(F.transform(X.spans(text_column, _ANY_TOKEN), lambda x: x.value))).alias("pseudonym")).distinct().withColumn("used", F.lit(1))
    return pairs.select(session, "pseudonym").distinct().join(merged(used), [session, "pseudonym"], "left").groupBy(session).agg(F.count("used").alias("used"), F.sum(F.when(F.col("used").isNull(), 1).otherwise(0)).alias("unused"))


def security_view(text: Column) -> Column:
    """Without format characters, then without runs of white space; single spaces stay."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{Cf}", ""), r"(?U)\s{2,}", "")


def leaks(masked: DataFrame, found: DataFrame, text_column: str = "masked", id_column: str = "doc_id") -> DataFrame:
    """(id, decision, labels): what a detector still finds in masked text (found: id, s, e, data_type), outside its highlights, and
    runs of six digits or more. A blocked row carries no text."""
    marks = F.col("highlights")
    inside = lambda s, e: F.exists(marks, lambda h: (h.s <= s) & (e <= h.e))
    spans_ = found.groupBy(id_column).agg(F.collect_list(F.struct("s", "e", "data_type")).alias("_f"))
    d = masked.join(merged(spans_), id_column, "left")
    typed = F.transform(F.filter(F.coalesce("_f", F.array().cast("array<struct<s:int,e:int,data_type:string>>")), lambda x: ~inside(x.s, x.e)), lambda x: x.data_type)
    loose = F.transform(F.filter(orphan_digits(F.coalesce(F.col(text_column), F.lit(""))), lambda x: ~inside(x.s, x.e)), lambda x: F.concat(F.lit("orphan_digits:"), F.length(x.value).cast("string")))
    labels = F.array_sort(F.array_distinct(F.concat(typed, loose)))
    blocked = F.size(labels) > 0
    return d.select(id_column, F.when(blocked, "blocked").otherwise("pass").alias("decision"), labels.alias("labels"), F.when(~blocked, F.col(text_column)).alias("text"))
