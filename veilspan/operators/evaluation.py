"""Scoring of detectors and the checks around a benchmark, as joins, windows and grouping sets.

gold and predictions: (doc_id, s, e, data_type), half-open code-point spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.layout import settle


def match(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, data_type, tp, fp, fn): in each document and type, gold spans in order take the first free overlapping prediction."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id", "data_type").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias(name))

    both = side(gold, "g").join(side(predicted, "p"), ["doc_id", "data_type"], "full")
    none = F.array().cast("array<struct<s:int,e:int>>")
    g, p = F.coalesce("g", none), F.coalesce("p", none)

    def take(acc, x):
        free = F.filter(acc.left, lambda y: (y.s < x.e) & (x.s < y.e))
        first = F.element_at(free, 1)
        rest = F.filter(acc.left, lambda y, i: i != F.array_position(acc.left, first) - 1)
        return F.when(F.size(free) > 0, F.struct((acc.n + 1).alias("n"), rest.alias("left"))).otherwise(acc)

    cast = F.transform(p, lambda y: F.struct(y.s.cast("int").alias("s"), y.e.cast("int").alias("e")))
    gold_ = F.transform(g, lambda y: F.struct(y.s.cast("int").alias("s"), y.e.cast("int").alias("e")))
    tp = F.aggregate(gold_, F.struct(F.lit(0).alias("n"), cast.alias("left")), take, lambda a: a.n)
    return both.select("doc_id", "data_type", tp.cast("long").alias("tp"), (F.size(p) - tp).cast("long").alias("fp"), (F.size(g) - tp).cast("long").alias("fn"))


def rates(tp: str | Column = "tp", fp: str | Column = "fp", fn: str | Column = "fn") -> dict[str, Column]:
    """precision, recall, f1, f2; 0 where nothing can be divided."""
    tp, fp, fn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn))
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "f2": F.coalesce(F.try_divide(5 * p * r, 4 * p + r), F.lit(0.0))}


def summary(matches: DataFrame, slices: DataFrame) -> DataFrame:
    """Overall, by type and by slice in one pass of grouping sets; the level says which."""
    m = matches.join(slices, "doc_id")
    m.createOrReplaceTempView("_veilspan_matches")
    out = m.sparkSession.sql("SELECT data_type, slice, grouping_id(data_type, slice) AS level, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM _veilspan_matches GROUP BY GROUPING SETS ((), (data_type), (slice))")
    return out.withColumns(rates())


def _covered(spans_: Column) -> Column:
    """How many characters the intervals cover together: one pass over them in order, with the end reached so far."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a.n + F.greatest(x.e - F.greatest(x.s, a.end), F.lit(0))).alias("n"), F.greatest(a.end, x.e).alias("end"))
    return F.aggregate(F.array_sort(spans_), start, step, lambda a: a.n.cast("long"))


def coverage(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, gold_chars, predicted_chars, common_chars), whatever the types; by intervals, not by single characters.

    What both have in common is what they cover each, less what they cover together; so no interval meets another.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))).alias(name))

    both = side(gold, "g").join(side(predicted, "p"), "doc_id", "full")
    none = F.array().cast("array<struct<s:int,e:int>>")
    g, p = F.coalesce("g", none), F.coalesce("p", none)
    out = both.select("doc_id", _covered(g).alias("gold_chars"), _covered(p).alias("predicted_chars"), _covered(F.concat(g, p)).alias("_either"))
    return out.select("doc_id", "gold_chars", "predicted_chars", (F.col("gold_chars") + F.col("predicted_chars") - F.col("_either")).alias("common_chars"))


def exact(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold spans that a prediction equals in place and type."""
    return gold.join(predicted.select("doc_id", "s", "e", "data_type").distinct(), ["doc_id", "s", "e", "data_type"], "left_semi")


def bootstrap(per_doc: DataFrame, iterations: int = 1000, seed: int = 42, percentile: float = 95.0) -> DataFrame:
    """low and high of F2 over resampled documents (tp, fp, fn each): each time as many documents as there are, with replacement.

    The n draws of a resample are dealt over documents as one multinomial draw. Documents of the same counts are one row with their
    number: a multinomial draw over such rows is that over their documents, summed. Rows lie in blocks; for each resample a seeded
    generator first deals n over the blocks, then each block's share over its rows, so blocks need nothing of one another and a retried
    task draws the same. Work grows with the different counts, not with the documents.
    """
    spark = per_doc.sparkSession
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = ("tp", "fp", "fn")
    alike = settle(per_doc.select(*(F.col(c).cast("long").alias(c) for c in counts)).groupBy(*counts).agg(F.count("*").alias("n")))
    dealt = alike.withColumn("_b", F.pmod(F.xxhash64(*counts), F.lit(blocks)).cast("int"))
    sizes = dict(dealt.groupBy("_b").agg(F.sum("n")).collect())  # one row for each block
    total, kinds = sum(sizes.values()), sorted(sizes)

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(counts), ignore_index=True)
        values, weight = pdf[["tp", "fp", "fn"]].to_numpy(), pdf["n"].to_numpy() / pdf["n"].sum()
        share = np.array([sizes[k] for k in kinds]) / total
        out = np.empty((iterations, 3), np.int64)
        for i in range(iterations):
            own = np.random.default_rng([seed, i]).multinomial(total, share)[kinds.index(key[0])]
            times = np.random.default_rng([seed, i, key[0] + 1]).multinomial(own, weight)
            out[i] = times @ values
        return pd.DataFrame({"i": np.arange(iterations), "tp": out[:, 0], "fp": out[:, 1], "fn": out[:, 2]})

    sums = dealt.groupBy("_b").applyInPandas(draw, "i long, tp long, fp long, fn long")
    f2 = sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumns(rates())
    ranked = f2.withColumn("r", F.row_number().over(Window.orderBy("f2", "i")) - 1)  # as many rows as iterations
    tail = (100 - percentile) / 200
    return ranked.agg(F.max(F.when(F.col("r") == int(tail * iterations), F.col("f2"))).alias("low"), F.max(F.when(F.col("r") == min(iterations - 1, int((1 - tail) * iterations)), F.col("f2"))).alias("high"))


def stratified(rows: DataFrame, stratum: str, id_column: str, k: int, seed: int = 7) -> DataFrame:
    """k rows of each stratum, by a hash of the id."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), id_column), id_column)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def parse_markup(rows: DataFrame, column: str = "annotated", id_column: str = "doc_id") -> DataFrame:
    """(id, text, spans) of texts with [[TYPE|value]] marks."""
    marks = X.spans(column, r"\[\[[A-Z_]+\|.*?\]\]")
    kind = lambda v: F.regexp_extract(v, r"\[\[([A-Z_]+)\|", 1)
    value = lambda v: F.regexp_extract(v, r"\|(.*?)\]\]", 1)
    plain = X.rebuild(F.col(column), marks, lambda x: value(x.value))
    shift = F.aggregate(
        marks, F.struct(F.lit(0).alias("by"), F.array().cast("array<struct<s:int,e:int,data_type:string>>").alias("out")),
        lambda a, x: F.struct((a.by + F.length(value(x.value)) - (x.e - x.s)).alias("by"), F.concat(a.out, F.array(F.struct((x.s + a.by).cast("int").alias("s"), (x.s + a.by + F.length(value(x.value))).cast("int").alias("e"), kind(x.value).alias("data_type")))).alias("out")),
        lambda a: a.out,
    )
    return rows.select(id_column, plain.alias("text"), shift.alias("spans"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, matched): the most pairs of overlapping spans of one type that two annotators' spans can form (augmenting paths)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "data_type"))).alias(name))

    @F.pandas_udf("long")
    def most(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_matching(x, y) for x, y in zip(left, right)])

    both = side(a, "x").join(side(b, "y"), "doc_id", "full")
    none = F.array().cast(both.schema["x"].dataType)
    return both.select("doc_id", most(F.coalesce("x", none), F.coalesce(F.col("y").cast(both.schema["x"].dataType), none)).alias("matched"))


def _matching(left, right) -> int:
    near = [[j for j, y in enumerate(right) if x["s"] < y["e"] and y["s"] < x["e"] and x["data_type"] == y["data_type"]] for x in left]
    of: dict[int, int] = {}  # right to left
    matched = 0
    for start in range(len(near)):
        via: dict[int, int] = {}  # right: the left that looked at it first
        todo, end = [start], None
        while todo and end is None:
            i = todo.pop()
            for j in near[i]:
                if j not in via:
                    via[j] = i
                    if j not in of:
                        end = j
                        break
                    todo.append(of[j])
        if end is not None:
            matched += 1
            while end is not None:  # the path's pairs change places
                i = via[end]
                before = next((j for j, k in of.items() if k == i), None) if i != start else None
                of[end] = i
                end = before
    return matched


def chain_breaks(log: DataFrame, order: str, previous: str, own: str) -> DataFrame:
    """Rows whose previous hash is not the hash of the row before (the first row's must be null or empty).

    The row before has the largest smaller order. Orders are dealt into ranges; each range looks back within itself, and its first row
    at the last row of the ranges before, one row for each range.
    """
    parts = max(1, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(log.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    place = sum((F.when(F.col(order) >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    rows = log.withColumn("_range", place)
    within = Window.partitionBy("_range").orderBy(order)
    last = rows.groupBy("_range").agg(F.max_by(own, order).alias("_end"))
    ahead = last.select((F.col("_range")).alias("_r"), F.lag("_end").over(Window.orderBy("_range")).alias("_end"))  # one row for each range
    rows = rows.withColumns({"_lag": F.lag(own).over(within), "_first": F.row_number().over(within) == 1}).join(F.broadcast(ahead), F.col("_range") == F.col("_r"))
    before = F.coalesce(F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_lag")), F.lit(""))
    return rows.where(F.coalesce(F.col(previous), F.lit("")) != before).select(*log.columns)


def inversions(rows: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """(group, inversions): pairs in order by place whose values are in the opposite order; groups without one are left out.

    The values of a group, in order, are counted by a merge sort; nothing is joined with itself.
    """
    @F.pandas_udf("long")
    def count(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: _inversions(list(v)))

    per = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v")))).alias("_x"))
    return per.select(group, count(F.transform("_x", lambda x: x.v)).alias("inversions")).where("inversions > 0")


def _inversions(v: list) -> int:
    n, total, width = len(v), 0, 1
    while width < n:
        out = []
        for lo in range(0, n, 2 * width):
            a, b = v[lo : lo + width], v[lo + width : lo + 2 * width]
            i = j = 0
            while i < len(a) and j < len(b):
                if a[i] <= b[j]:
                    out.append(a[i])
                    i += 1
                else:
                    out.append(b[j])
                    j += 1
                    total += len(a) - i
            out += a[i:] + b[j:]
        v, width = out, 2 * width
    return total


def calibrate(scored: DataFrame, grid=tuple(round(0.5 + 0.02 * i, 2) for i in range(25)), slack: float = 0.005) -> DataFrame:
    """(label, threshold): the highest threshold of the grid before recall first falls more than slack below that of the lowest.

    scored: (label, score, correct), one row for each gold span that was found, with its score, or with score null where it was not.
    """
    steps = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold")
    kept = scored.select("label", "score", "correct", steps).groupBy("label", "threshold").agg((F.sum(F.when(F.col("correct") & (F.col("score") >= F.col("threshold")), 1).otherwise(0)) / F.count("*")).alias("recall"))
    base = kept.groupBy("label").agg(F.max_by("recall", -F.col("threshold")).alias("base"))
    judged = kept.join(base, "label").withColumn("ok", F.col("recall") >= F.col("base") - slack)
    first_bad = judged.groupBy("label").agg(F.min(F.when(~F.col("ok"), F.col("threshold"))).alias("bad"))
    return judged.join(first_bad, "label").where(F.col("bad").isNull() | (F.col("threshold") < F.col("bad"))).groupBy("label").agg(F.max("threshold").alias("threshold"))


def parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row: spans of two engines that only one has, the largest difference of confidence, and whether all is within tolerance."""
    key = ["doc_id", "s", "e", "data_type"]
    j = a.select(*key, F.col("score").alias("x")).join(b.select(*key, F.col("score").alias("y")), key, "full")
    gap = F.max(F.abs(F.col("x") - F.col("y")))
    alone = F.sum(F.when(F.col("x").isNull() | F.col("y").isNull(), 1).otherwise(0))
    return j.agg(alone.alias("unmatched"), F.coalesce(gap, F.lit(0.0)).alias("max_delta"), ((alone == 0) & (F.coalesce(gap, F.lit(0.0)) <= tolerance)).alias("same"))


def compare_runs(current: DataFrame, baseline: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """(metric, ratio, verdict) of a run against a baseline: ok, slower, or missing."""
    j = baseline.select("metric", F.col("value").alias("base")).join(current.select("metric", "value"), "metric", "left")
    ratio = F.try_divide("value", "base")
    return j.select("metric", ratio.alias("ratio"), F.when(F.col("value").isNull(), "missing").when(ratio > 1 + tolerance, "slower").otherwise("ok").alias("verdict"))


def merge_boxes(boxes: DataFrame, gap: float = 6.0, same_line: float = 2.0) -> DataFrame:
    """Boxes (doc_id, page, x, y, width, height) of one line that stand within a gap become one: islands over running right edges."""
    line = Window.partitionBy("doc_id", "page", "line").orderBy("x", "width")
    b = boxes.withColumn("line", F.round(F.col("y") / same_line))
    edge = F.max(F.col("x") + F.col("width")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("new", F.when(edge.isNull() | (F.col("x") > edge + gap), 1).otherwise(0)).withColumn("island", F.sum("new").over(line))
    return b.groupBy("doc_id", "page", "line", "island").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"), F.count("*").alias("boxes")).drop("line", "island")


def cache_keys(prompts: DataFrame, config: str) -> DataFrame:
    """prompts (prompt, text) with key: the first 32 hex digits of a hash of all that decides a response."""
    sep = F.decode(F.unhex(F.lit("00")), "utf-8")
    return prompts.withColumn("key", F.substring(F.sha2(F.concat(F.lit(config), sep, "prompt", sep, "text", sep), 256), 1, 32))


def cached(prompts: DataFrame, responses: DataFrame, schema: int) -> DataFrame:
    """prompts with the response of an equal key and schema, null where there is none."""
    return prompts.join(responses.where(F.col("schema") == schema).select("key", "response").dropDuplicates(["key"]), "key", "left")


def shards(values: DataFrame, index: str, held_out: int = 9, parts: int = 10) -> DataFrame:
    """values with split: those whose index falls on held_out are for development, so that no value is in both."""
    return values.withColumn("split", F.when(F.pmod(F.col(index), F.lit(parts)) == held_out, "dev").otherwise("train"))


def upweight(rows: DataFrame, is_hard: Column, times: int = 3) -> DataFrame:
    """Hard rows so many times, others once."""
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.when(is_hard, times).otherwise(1)))).drop("_k")


def contaminated(train: DataFrame, test: DataFrame, column: str = "text") -> DataFrame:
    """Training rows whose text is in the test set: must be empty."""
    return train.join(test.select(column).distinct(), column, "left_semi")


def locate_values(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, data_type, s, e) of claimed values (doc_id, data_type, value) in their texts, longest value first, no place twice."""
    v = values.where(F.length("value") > 0).groupBy("doc_id").agg(F.collect_set(F.struct("value", "data_type")).alias("v"))
    quote = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    def places(x):
        n = F.length(x.value)
        spot = lambda s: F.struct((-n).alias("k"), s.alias("s"), (s + n).alias("e"), x.data_type.alias("data_type"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<k:int,s:int,e:int,data_type:string>>").alias("out"))
        step = lambda a, gap: F.struct((a.at + F.length(gap) + n).alias("at"), F.concat(a.out, F.array(spot(a.at + F.length(gap)))).alias("out"))
        return X.let(F.split(F.col("text"), quote(x.value), -1), lambda gaps: F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), start, step, lambda a: a.out))

    found = F.flatten(F.transform("v", places))
    order = lambda a, b: F.when(F.struct(a.k, a.s, a.data_type) < F.struct(b.k, b.s, b.data_type), -1).otherwise(1)
    return docs.join(v, "doc_id").select("doc_id", F.explode(X.keep_best(found, order)).alias("x")).select("doc_id", "x.data_type", "x.s", "x.e")
