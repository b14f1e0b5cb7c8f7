"""Around a benchmark: views of the type scheme, audits of addresses, answers of language models, drafts of a corpus, readings and roll-ups."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.layout import tasks_for
from . import evaluation
from .structured import Span, Taken

# The types that are scored, and the layers of the slices.
SHARED = ("THAI_ID", "PHONE", "EMAIL", "BANK_ACCOUNT", "CREDIT_CARD", "PASSPORT", "VEHICLE_PLATE", "STUDENT_ID", "DATE_OF_BIRTH", "NAME", "ADDRESS")
OUT_OF_SCHEME = "OUT_OF_SCHEME"
SLICES = {s: layer for layer, names in (("balanced", "name_no_cue address_varied messy bank_phone id_docs student_id_varied"), ("natural", "gov_form medical finance education long_form"), ("negative", "negative")) for s in names.split()}
LONG_FORM_ZONES, LONG_FORM_CHARS = (150, 350), 500


def in_scheme(predicted: DataFrame, shared_only: bool, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """Predictions of the shared types; others are left out, or all called the same."""
    known = F.col("data_type").isin(*shared)
    return predicted.where(known) if shared_only else predicted.withColumn("data_type", F.when(known, F.col("data_type")).otherwise(F.lit(OUT_OF_SCHEME)))


def excluded(predicted: DataFrame, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """One row: how many predictions the shared view leaves out."""
    return predicted.agg(F.sum(F.when(F.col("data_type").isin(*shared), 0).otherwise(1)).cast("long").alias("excluded"))


def families(scores: DataFrame, family: dict[str, tuple[str, ...]], value: str = "f2") -> DataFrame:
    """(family, value): the mean over the listed types; a type without a score counts as 0."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("data_type"), F.lit(len(types)).alias("n")) for f, types in family.items() for t in types])).alias("x")
    d = scores.select("data_type", F.col(value).alias("v"))
    listed = d.sparkSession.range(1).select(rows).select("x.*")
    return listed.join(d, "data_type", "left").groupBy("family").agg((F.sum(F.coalesce("v", F.lit(0.0))) / F.max("n")).alias(value))


def negative_slice(gold: DataFrame, predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """One row over documents without gold spans: predictions in them, and how many documents have none. Recall has no meaning there."""
    clean = docs.select("doc_id").join(gold.select("doc_id").distinct(), "doc_id", "left_anti")
    per = clean.join(predicted.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("false_positives"), F.count("*").alias("documents"), F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)).cast("long").alias("clean_documents"))


def address_audit(gold: DataFrame, predicted: DataFrame, kind: str = "ADDRESS") -> DataFrame:
    """One row: predicted addresses that no gold address takes, and how many of them lie within or outside of one."""
    pick = lambda df, name: df.where(F.col("data_type") == kind).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias(name))
    both = pick(predicted, "p").join(pick(gold, "g"), "doc_id", "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    g = F.coalesce("g", none)

    def take(left, x):
        at = F.array_position(F.transform(left, lambda y: (y.s < x.e) & (x.s < y.e)), F.lit(True))
        return F.when(at > 0, F.filter(left, lambda y, i: i != at - 1)).otherwise(left)

    free = F.aggregate(g, F.col("p"), take)
    d = both.select(free.alias("free"), g.alias("g")).select(F.size("free").alias("n"), F.size(F.filter("free", lambda x: F.exists("g", lambda y: (y.s <= x.s) & (x.e <= y.e)))).alias("inside"))
    total, inside = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("inside"), F.lit(0))
    return d.agg(total.cast("long").alias("unmatched"), inside.cast("long").alias("inside"), (total - inside).cast("long").alias("outside"))


def _compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many different spans both have (place and label; a null is equal to nothing), the first alone, the second alone.

    Both sides meet in one aggregate instead of a join of sorted sides, in tasks that grow in number with the input: their number is
    given, so that Spark does not merge small compressed blocks to tasks of very many rows.
    """
    key = ["doc_id", "s", "e", "data_type"]
    side = lambda df, n: df.select(*key, F.lit(n == 1).alias("_a"), F.lit(n == 2).alias("_b"))
    rows = side(a, 1).unionByName(side(b, 2)).repartition(tasks_for(a.select(key), b.select(key)), "doc_id")
    spans = rows.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    both = F.col("_a") & F.col("_b")
    for c in key:
        both = both & F.col(c).isNotNull()
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return spans.agg(n(both).alias("both"), n(F.col("_a") & ~both).alias("first"), n(F.col("_b") & ~both).alias("second"))


def span_f1(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and F1 of spans that must be the same in place and label."""
    d = _compared(gold, predicted).select(F.col("both").alias("tp"), F.col("second").alias("fp"), F.col("first").alias("fn"))
    r = evaluation.rates()
    return d.withColumns({"precision": r["precision"], "recall": r["recall"], "f1": r["f1"]})


def agreement_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: spans of two annotators that are the same, that one alone has, and labelled characters that both or one alone have."""
    exact = _compared(a, b).select(F.col("both").alias("same"), F.col("first").alias("only_a"), F.col("second").alias("only_b"))
    typed = lambda df: df.select(F.concat_ws("|", F.col("doc_id").cast("string"), "data_type").alias("doc_id"), "s", "e")
    chars = evaluation.coverage(typed(a), typed(b)).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("chars_both", F.col("common_chars")), ("chars_a", F.col("gold_chars") - F.col("common_chars")), ("chars_b", F.col("predicted_chars") - F.col("common_chars")))])
    return exact.crossJoin(F.broadcast(chars))  # one row each


# --- answers of language models ---------------------------------------------------------------------------------------------------
_THOUGHT, _OPEN, _FENCE, _OBJECT = re.compile(r"<think>.*?</think>", re.S), re.compile(r"<think>.*\Z", re.S), re.compile(r"\A```[a-zA-Z]*\s*|\s*```\Z"), re.compile(r"\{[^{}]*\}")


def answer_rows(raw: str | None) -> list[tuple[str, str]]:
    """(type, value) of an answer that is a JSON array, one object, an array within other words, or objects one after the other.

    Thoughts and fences are left out; a thought without an end means that there was no answer.
    """
    text = _FENCE.sub("", _OPEN.sub("", _THOUGHT.sub("", raw or "")).strip())

    def parsed(part: str):
        try:
            return json.loads(part)
        except ValueError:
            return None

    whole = parsed(text)
    if whole is None:
        inner = parsed(text[text.find("[") : text.rfind("]") + 1]) if "[" in text else None
        rows = inner if isinstance(inner, list) else [parsed(m[0]) for m in _OBJECT.finditer(text)]
    else:
        rows = whole if isinstance(whole, list) else [whole]
    return [(str(r.get("type", "")).strip().upper(), r["value"]) for r in rows if isinstance(r, dict) and isinstance(r.get("value"), str) and r["value"].strip()]


def parse_answers(answers: DataFrame, column: str = "answer", id_column: str = "doc_id") -> DataFrame:
    """(id, data_type, value) of each answer's rows; an answer that is a plain array of objects does not go to Python."""
    kind = "array<struct<type:string,value:string>>"

    @F.pandas_udf(kind)
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: [{"type": t, "value": v} for t, v in answer_rows(r)])

    plain = F.when(F.col(column).rlike(r"^\s*\[\s*\{"), F.from_json(F.col(column), kind))
    tidy = F.transform(F.filter(plain, lambda x: F.trim(x["value"]) != ""), lambda x: F.struct(F.upper(F.trim(F.coalesce(x["type"], F.lit("")))).alias("type"), x["value"].alias("value")))
    good = plain.isNotNull() & ~F.exists(plain, lambda x: x["value"].isNull())
    rows = F.when(F.coalesce(good, F.lit(False)), tidy).otherwise(run(F.when(F.coalesce(good, F.lit(False)), F.lit("")).otherwise(F.coalesce(F.col(column), F.lit("")))))
    return answers.select(F.col(id_column), F.explode(rows).alias("x")).select(id_column, F.col("x.type").alias("data_type"), "x.value")


def unlocated(values: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, unlocatable): claimed values that have no place in their text. found: as from evaluation.locate_values, with value."""
    rest = values.select("doc_id", "data_type", "value").distinct().join(found.select("doc_id", "data_type", "value").distinct(), ["doc_id", "data_type", "value"], "left_anti")
    return rest.groupBy("doc_id").agg(F.count("*").alias("unlocatable"))


# --- drafts -----------------------------------------------------------------------------------------------------------------------
def validate_draft(records: DataFrame, minimums: dict[str, int] | None = None, types: tuple[str, ...] = SHARED) -> DataFrame:
    """(doc_id, error) of a draft corpus (doc_id, slice, layer, annotated): one union of constraint queries; values are never told."""
    marks = X.spans("annotated", r"\[\[[A-Z_]+\|.*?\]\]")
    layer = F.element_at(F.create_map(*[F.lit(x) for kv in SLICES.items() for x in kv]), F.col("slice"))
    parsed = evaluation.parse_markup(records.select("doc_id", "annotated")).select("doc_id", "text", "spans")
    d = records.withColumn("_layer", layer).withColumn("_marks", F.size(marks)).join(parsed, "doc_id")
    known = d.where(F.col("_layer").isNotNull())
    positive = known.where("slice <> 'negative'")
    say = lambda df, error: df.select(F.col("doc_id").cast("string").alias("doc_id"), (error if isinstance(error, Column) else F.lit(error)).alias("error"))
    starts = F.transform("spans", lambda x: x.s)
    low, high = LONG_FORM_ZONES
    zones = F.exists(starts, lambda s: s < low) & F.exists(starts, lambda s: (s >= low) & (s <= high)) & F.exists(starts, lambda s: s > high)
    rows = positive.select("doc_id", "text", F.explode("spans").alias("x")).select("doc_id", "x.data_type", F.substring(F.col("text"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("value"))
    typed = rows.where(F.col("data_type").isin(*types))
    digits = X.only_digits("value")
    reused = typed.groupBy("data_type", "value").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("data_type", "value", "first")
    parts = [
        say(records.groupBy("doc_id").count().where("count > 1"), "duplicate-doc-id"), say(d.where(F.col("_layer").isNull()), "unknown-slice"), say(known.where(~F.col("layer").eqNullSafe(F.col("_layer"))), "layer-mismatch"),
        say(known.where(F.col("text").contains("[[") | F.col("text").contains("]]")), "unbalanced-markup"), say(known.where("slice = 'negative' AND _marks > 0"), "negative-has-markup"),
        say(known.where("slice = 'negative'").where(F.col("text").rlike("[0-9]{13}")), "negative-contains-13-digit-run"), say(positive.where("_marks = 0"), "positive-doc-without-entities"),
        say(positive.where((F.col("slice") == "long_form") & (F.length("text") <= LONG_FORM_CHARS)), "long-form-too-short"), say(positive.where((F.col("slice") == "long_form") & ~zones), "long-form-missing-boundary-zone-entity"),
        say(rows.where(~F.col("data_type").isin(*types)), F.concat(F.lit("unknown-type-"), "data_type")), say(typed.where((F.col("data_type") == "THAI_ID") & ~X.thai_id_ok("value")), "thai-id-bad-checksum"),
        say(typed.where((F.col("data_type") == "CREDIT_CARD") & ~(F.length(digits).between(13, 16) & X.luhn_ok("value"))), "credit-card-bad-checksum"),
        say(typed.join(reused, ["data_type", "value"]).where(F.col("doc_id") != F.col("first")).select("doc_id", "data_type", "value").distinct(), "value-reused-across-docs"),
    ]
    if minimums:
        want = F.explode(F.array(*[F.struct(F.lit(k).alias("data_type"), F.lit(n).alias("least")) for k, n in minimums.items()])).alias("x")
        have = records.sparkSession.range(1).select(want).select("x.*").join(typed.groupBy("data_type").count(), "data_type", "left")
        parts.append(have.where(F.coalesce("count", F.lit(0)) < F.col("least")).select(F.lit("<corpus>").alias("doc_id"), F.concat(F.lit("type-below-minimum-"), "data_type").alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- readings ---------------------------------------------------------------------------------------------------------------------
def distances(value: str, text: str, anchored: bool = False) -> Iterator[int]:
    """Edits from a value to the part of a text that ends before each character and after the last, with the part's best start; anchored:
    to the whole text so far. A column of the table of edits is two numbers of a bit for each character of the value."""
    n = len(value)
    where: dict[str, int] = {}
    for i, c in enumerate(value):
        where[c] = where.get(c, 0) | 1 << i
    full, last, up, down, edits = (1 << n) - 1, n - 1, (1 << n) - 1, 0, n
    yield edits
    for c in text:
        same = where.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        right, left = (down | ~(level | up)) & full, up & level
        if n:
            edits += (right >> last & 1) - (left >> last & 1)
        elif anchored:
            edits += 1
        same |= down
        right, left = (right << 1 | anchored) & full, left << 1 & full
        up, down = (left | ~(same | right)) & full, right & same
        yield edits


def nearest_part(value: str, text: str) -> tuple[int, int, int]:
    """(edits, start, end) of the part of a text that is closest to a value; the first such, and of those that end there the shortest."""
    edits, end = min((d, j) for j, d in enumerate(distances(value, text)))
    length = next(k for k, d in enumerate(distances(value[::-1], text[max(0, end - len(value) - edits) : end][::-1], True)) if d == edits)
    return edits, end - length, end


def reading_accuracy(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, i, status, accuracy) of expected values (doc_id, i, value) in texts that were read: 1 - edits / length at the closest
    part. The best takes its place first; another that needs the same place is in conflict. A text without characters is skipped."""
    kind = "array<struct<i:int,status:string,accuracy:double>>"

    @F.pandas_udf(kind)
    def run(text: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(text, wanted):
            done, taken = [], Taken()
            for r in rows:
                if not t:
                    done.append((1, 0.0, 0, r["i"], "skipped", None, 0, 0))
                else:
                    edits, s, e = nearest_part(r["value"], t)
                    accuracy = round(1 - edits / max(len(r["value"]), 1), 4)
                    done.append((0, -accuracy, edits, r["i"], "measured", accuracy, s, e))
            res = []
            for _, _, _, i, status, accuracy, s, e in sorted(done, key=lambda x: x[:4]):
                if status == "measured" and s < e and not taken.add(Span(s, e, "", 0.0)):
                    status = "alignment_conflict"
                res.append({"i": i, "status": status, "accuracy": accuracy})
            out.append(res)
        return pd.Series(out, dtype=object)

    per = values.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "value"))).alias("wanted"))
    d = texts.join(per, "doc_id").select("doc_id", F.explode(run(F.coalesce("text", F.lit("")), "wanted")).alias("x"))
    return d.select("doc_id", "x.*")


def residual(measured: DataFrame, dark: float = 0.95, ink: float = 0.02) -> DataFrame:
    """measured (black: share of black in a value's boxes, above: ink in the strip over them, text_survives; null where not measured)
    with verdict: exposed, unmeasurable, ink_above_box or removed. Pixels are measured elsewhere."""
    verdict = (
        F.when(F.col("text_survives"), "exposed").when(F.col("black").isNull() | F.col("text_survives").isNull(), "unmeasurable")
        .when(F.col("black") < dark, "exposed").when(F.coalesce("above", F.lit(0.0)) > ink, "ink_above_box").otherwise("removed")
    )
    return measured.withColumn("verdict", verdict)


def acceptance(runs: DataFrame, counters: list[str], rules: dict[str, Column], id_column: str = "input_id") -> tuple[DataFrame, DataFrame]:
    """One row with the sums of counters and the number of inputs that pass; and (id, code) of each rule that an input fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]), lambda x: x.isNotNull())
    d = runs.withColumn("_failed", failed)
    total = d.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters], F.count("*").alias("inputs"), F.sum(F.when(F.size("_failed") == 0, 1).otherwise(0)).cast("long").alias("passed"))
    return total, d.select(id_column, F.explode("_failed").alias("code"))


def reveals(log: DataFrame, budget: int, version: str = "version") -> DataFrame:
    """(version, reveals, left, over_budget): how often each sealed version was opened."""
    n = F.count("*")
    return log.groupBy(version).agg(n.alias("reveals"), F.greatest(F.lit(budget) - n, F.lit(0)).cast("long").alias("left"), (n > budget).alias("over_budget"))


def survival(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, i, how) of values (doc_id, i, value) in texts: exact, spaced (the same but for white space) or lost."""
    d = values.join(texts, "doc_id", "left")
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s", "")
    return d.select("doc_id", "i", F.when(F.col("text").contains(F.col("value")), "exact").when((bare("value") != "") & bare("text").contains(bare("value")), "spaced").otherwise("lost").alias("how"))


def rows_of_boxes(words: DataFrame, gap: float = 4.0) -> DataFrame:
    """words (doc_id, page, x, y) with row: a new one begins where y grows by more than the gap."""
    w = Window.partitionBy("doc_id", "page").orderBy("y", "x")
    return words.withColumn("_new", F.when(F.col("y") - F.lag("y").over(w) <= gap, 0).otherwise(1)).withColumn("row", F.sum("_new").over(w).cast("int")).drop("_new")


def distinct_files(found: DataFrame, path: str = "path") -> DataFrame:
    """Files once each: paths that differ by ".", ".." or doubled slashes are the same."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return found.withColumn(path, F.concat(F.when(F.col(path).startswith("/"), "/").otherwise(""), F.array_join(up, "/"))).dropDuplicates([path])
