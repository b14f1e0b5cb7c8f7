"""Native column functions: spans of a pattern, checks of numbers, cleaning and folding of values.

Java's dialect differs from Python's: patterns get the flags (?Ud), and word classes are written out where they matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once. What a lambda takes from outside is evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


_BLOCK = 64


def spans(text: str | Column, pattern: str, ignore_case: bool = False) -> Column:
    """array<struct<s,e,value>> of all matches, in order, with code-point offsets (s inclusive, e exclusive).

    The gaps around the matches and the matches alternate, so running sums of their lengths are the offsets. (regexp_instr counts
    UTF-16 units and would be wrong after an astral character.) Adding to an array copies it: many matches are summed in blocks of
    about the square root of their number, which then move to where their block begins.
    """
    t, p = _c(text), "(?Ud" + ("iu" if ignore_case else "") + ")" + pattern
    found, gaps = F.regexp_extract_all(t, F.lit(p), F.lit(0)), F.split(t, p, -1)
    none = F.array().cast("array<struct<s:int,e:int,value:string>>")

    def step(acc, pair):
        s = acc.at + F.length(pair.gap)
        e = s + F.length(pair.value)
        return F.struct(e.alias("at"), F.concat(acc.out, F.array(F.struct(s.alias("s"), e.alias("e"), pair.value.alias("value")))).alias("out"))

    def fold(pairs):
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def move(acc, block):
        moved = F.transform(block.out, lambda x: F.struct((x.s + acc.at).alias("s"), (x.e + acc.at).alias("e"), x.value.alias("value")))
        return F.struct((acc.at + block.at).alias("at"), F.concat(acc.out, F.array(moved)).alias("out"))

    def blocks(pairs):
        size = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        each = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, size), lambda at: fold(F.slice(pairs, at + 1, size)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,value:string>>>").alias("out"))
        return F.aggregate(each, start, move, lambda a: F.flatten(a.out))

    pairs = F.filter(F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap"))), lambda x: x.value.isNotNull())
    return F.coalesce(let(pairs, lambda p: F.when(F.size(p) <= _BLOCK, fold(p)["out"]).otherwise(blocks(p))), none)


def only_digits(value: str | Column) -> Column:
    return F.regexp_replace(_c(value), r"[^0-9]", "")


def luhn_ok(value: str | Column) -> Column:
    digits = only_digits(value)
    return (F.length(digits) > 0) & F.call_function("luhn_check", digits)


def thai_id_ok(value: str | Column) -> Column:
    """13 digits whose last is the check digit: (11 - sum of digit * (14 - place) mod 11) mod 10."""

    def right(digits):
        total = sum((F.substring(digits, i, 1).cast("int") * (14 - i) for i in range(2, 13)), F.substring(digits, 1, 1).cast("int") * 13)
        return (F.length(digits) == 13) & ((F.lit(11) - total % 11) % 10 == F.substring(digits, 13, 1).cast("int"))

    return let(only_digits(value), right)


def iban_ok(value: str | Column) -> Column:
    """The rest of the number modulo 97 is 1; folded character by character, as up to 60 digits fit no type."""
    v = _c(value)
    chars = F.split(F.concat(F.substring(v, 5, 1000), F.substring(v, 1, 4)), "")
    rest = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(F.upper(c)) - 55) % 97))
    return v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def clean_keeping_length(text: str | Column) -> Column:
    """Thai digits become ASCII digits; nothing moves."""
    return F.translate(_c(text), V.THAI_DIGITS, "0123456789")


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has none; texts of ASCII alone do not go to Python."""
    import unicodedata

    @F.pandas_udf("string")
    def run(column):
        return column.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, run(F.when(other, text))).otherwise(text)


def clean(text: str | Column, normalise: bool = True) -> Column:
    """Runs of spaces and of blank lines shortened, lines and text trimmed, NFC, Thai digits, zero-width characters removed."""
    t = F.regexp_replace(_c(text), " {2,}", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?Udm)[\s&&[^\n]]+$", "")
    t = F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")
    t = nfc(t) if normalise else t
    return F.regexp_replace(clean_keeping_length(t), "[​‌‍﻿]", "")


def canonical(data_type: str | Column, value: str | Column) -> Column:
    """The form under which values of a type are the same: digits of ids and phones (+66 as 0), folded e-mails, names without title."""
    kind, v = _c(data_type), _c(value)
    digits = F.regexp_replace(v, r"(?U)\D", "")
    tidy = F.lower(F.regexp_replace(F.regexp_replace(v, r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " "))
    phone = F.when(digits.startswith("66") & F.length(digits).isin(10, 11), F.concat(F.lit("0"), F.substring(digits, 3, 20))).otherwise(digits)
    name = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"(?U)\A\s+|\s+\z", ""), V.TITLES, ""), r"(?U)\s+", " "), r"(?U)\A\s+|\s+\z", ""))
    return (
        F.when(kind == "THAI_ID", digits).when(kind == "PHONE", phone).when(kind == "PASSPORT", F.upper(F.regexp_replace(v, r"(?U)[\s-]", "")))
        .when(kind == "EMAIL", F.lower(F.regexp_replace(v, r"(?U)\A\s+|\s+\z", ""))).when(kind == "NAME", name).otherwise(tidy)
    )


def keep_best(spans_: Column, order) -> Column:
    """A native fold: spans in the order of a comparator, each kept unless it overlaps one kept before."""
    empty = F.filter(spans_, lambda _: F.lit(False))
    take = F.aggregate(F.array_sort(spans_, order), empty, lambda kept, x: F.when(F.exists(kept, lambda y: (x.s < y.e) & (y.s < x.e)), kept).otherwise(F.concat(kept, F.array(x))))
    return F.array_sort(take, lambda a, b: F.when(a.s < b.s, -1).when(a.s > b.s, 1).otherwise(0))


def rebuild(text: Column, spans_: Column, replacement) -> Column:
    """Text with each span (in order, without overlaps) replaced, in one pass."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    fold = F.aggregate(spans_, start, lambda a, x: F.struct(x.e.cast("int").alias("at"), F.concat(a.out, F.substring(text, a.at + 1, x.s - a.at), replacement(x)).alias("out")))
    return F.concat(fold["out"], F.substring(text, fold["at"] + 1, F.length(text) + 1))
