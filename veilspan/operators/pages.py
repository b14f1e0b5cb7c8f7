"""Pages of words with boxes: joining pages, merging what was read twice, and entities as boxes. No PDF or OCR engine is part of this.

words: (doc_id, page, i, text, x, y, width, height), i the order in the page; with s, e where they lie in the page's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import looked_up, merged, settle
from . import identifiers

SEPARATOR = "\n\n"
SAME_PLACE, SAME_WORD = 0.5, 0.3  # share of the smaller box that two boxes have in common
STRIP = 64  # characters of a text that spans and words meet in
SURE, REVIEW = 0.9, 0.7  # confidence that ends the attempts; below which a person looks


def join_pages(pages: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text) of pages (doc_id, page, text) in order with an empty line between; words with s and e moved into it; and words
    whose box does not say what stands at its place: there should be none."""
    order = Window.partitionBy("doc_id").orderBy("page")
    at = F.coalesce(F.sum(F.length("text") + len(SEPARATOR)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pages.select("doc_id", "page", F.col("text").alias("_page"), at.cast("int").alias("_at"))
    texts = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p.text), SEPARATOR).alias("text"))
    w = words.join(placed, ["doc_id", "page"], "left")
    good = (F.col("s") >= 0) & (F.col("e") > F.col("s")) & (F.substring(F.col("_page"), F.col("s") + 1, F.col("e") - F.col("s")) == F.col("text"))
    good = F.coalesce(good, F.lit(False))
    moved = w.where(good).withColumns({"s": F.col("s") + F.col("_at"), "e": F.col("e") + F.col("_at")}).select(words.columns)
    return texts, moved, w.where(~good).select(words.columns)


def shared_area(a: str, b: str) -> Column:
    """The area that two boxes have in common, as a share of the smaller one."""
    c = lambda side, name: F.col(f"{side}.{name}")
    wide = F.greatest(F.least(c(a, "x") + c(a, "width"), c(b, "x") + c(b, "width")) - F.greatest(c(a, "x"), c(b, "x")), F.lit(0.0))
    high = F.greatest(F.least(c(a, "y") + c(a, "height"), c(b, "y") + c(b, "height")) - F.greatest(c(a, "y"), c(b, "y")), F.lit(0.0))
    return F.coalesce(F.try_divide(wide * high, F.least(c(a, "width") * c(a, "height"), c(b, "width") * c(b, "height"))), F.lit(0.0))


def meet(a: DataFrame, b: DataFrame, names: tuple[str, str], least: float) -> DataFrame:
    """(doc_id, page, a row of a, a row of b) of boxes of one page that share at least that much of the smaller one's area.

    Boxes are dealt to the cells of a grid over their page, with no more cells than the page has boxes and none smaller than a usual
    box. Two boxes meet in each cell that both touch and are told once, by the first of these. So a page's work grows with its boxes
    and with the pairs that overlap, and one page is many groups. Boxes without a size or place share no area.
    """
    place = ("doc_id", "page", "x", "y", "width", "height")
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    extent = lambda at, size: F.max(F.col(at) + F.col(size)) - F.min(at)
    root = F.sqrt(F.count("*"))
    grid = a.select(*place).unionByName(b.select(*place)).where(sized).groupBy("doc_id", "page").agg(
        F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(F.avg("width"), extent("x", "width") / root).alias("_w"), F.greatest(F.avg("height"), extent("y", "height") / root).alias("_h"))
    grid = looked_up(settle(grid))

    def cells(df: DataFrame, name: str) -> DataFrame:
        def cell(axis: str, size: str, end: bool) -> Column:
            far = F.col(axis) + F.col(size) if end else F.col(axis)
            return F.floor((far - F.col("_" + axis)) / F.col("_" + size[0])).cast("int")

        across = F.sequence(cell("x", "width", False), cell("x", "width", True))
        touched = F.flatten(F.transform(F.sequence(cell("y", "height", False), cell("y", "height", True)), lambda y: F.transform(across, lambda x: F.struct(x.alias("x"), y.alias("y")))))
        d = df.where(sized).join(grid, ["doc_id", "page"])
        first = cell("x", "width", False).alias(f"_{name}_x0"), cell("y", "height", False).alias(f"_{name}_y0")
        d = d.select("doc_id", "page", *(F.col(c).alias(f"_{name}.{c}") for c in df.columns), *first, F.explode(touched).alias("_cell"))
        return d.withColumns({"_cx": F.col("_cell.x"), "_cy": F.col("_cell.y")}).drop("_cell")

    def row(df: DataFrame, name: str) -> Column:
        return F.struct(*(F.col(f"`_{name}.{c}`").alias(c) for c in df.columns)).alias(name)

    left, right = names
    met = cells(a, left).join(merged(cells(b, right)), ["doc_id", "page", "_cx", "_cy"])
    once = (F.col("_cx") == F.greatest(f"_{left}_x0", f"_{right}_x0")) & (F.col("_cy") == F.greatest(f"_{left}_y0", f"_{right}_y0"))
    return met.where(once).select("doc_id", "page", row(a, left), row(b, right)).where(shared_area(left, right) >= least)


def _key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]", ""))


def _values(text: Column) -> Column:
    """Structured values in a word's text, each with its type."""
    def named(kind: str):
        return lambda x: F.concat(F.lit(kind + ":"), F.lower(x.value))

    parts = [F.transform(fn(text), named(k)) for k, (fn, _) in identifiers.NATIVE.items()]
    return F.array_distinct(F.concat(*parts))


def merge_layers(layer: DataFrame, read: DataFrame) -> DataFrame:
    """Words of the text layer and, after them, what recognition read besides: a word over layer words that says the same goes, one
    that says more keeps the rest, and one with a structured value that the layer lacks stays whole. source: layer or ocr."""
    under = meet(read, layer, ("r", "l"), SAME_PLACE).groupBy("doc_id", "page", F.col("r.i").alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l.x", "l.i", "l.text"))), lambda w: w.text), "").alias("_under"))
    d = read.join(under, ["doc_id", "page", "i"], "left")
    mine, theirs = _key(F.col("text")), _key(F.coalesce("_under", F.lit("")))
    own, known = _values(F.col("text")), _values(F.coalesce("_under", F.lit("")))
    said = (theirs != "") & mine.contains(theirs) & F.when(F.size(own) > 0, F.size(F.array_except(own, known)) == 0).otherwise(mine == theirs)
    rest = F.trim(F.regexp_replace(F.lower("text"), F.concat_ws(r"[^\p{L}\p{M}\p{N}]*", F.filter(F.split(theirs, ""), lambda c: c != "")), " "))
    text = F.when(F.coalesce(said, F.lit(False)), rest).otherwise(F.col("text"))
    kept = d.withColumn("text", text).where(F.col("text").rlike(r"[\p{L}\p{N}]")).select(read.columns)
    return layer.withColumn("source", F.lit("layer")).unionByName(kept.withColumn("source", F.lit("ocr")), allowMissingColumns=True)


def merge_attempts(words: DataFrame, confidences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (with attempt) of several readings of a page, and (doc_id, page, confidence, human_review).

    The surest attempt is the ground; of the others, surest first, words come in where no kept word lies or where they bring a new
    structured value. A word that the ground says at its place says nothing new. confidence: the least of the attempts that are used.
    """
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("confidence"), "attempt"))
    ranked = confidences.withColumns({"rank": rank, "_last": F.count("*").over(Window.partitionBy("doc_id", "page"))})  # a few rows for each page
    w = settle(words.join(merged(ranked), ["doc_id", "page", "attempt"]))  # read by all that follows
    keyed = w.withColumn("_key", _key(F.col("text")))
    later = keyed.where("rank > 1").select("doc_id", "page", "rank", "i", "x", "y", "width", "height", "_key")
    over = meet(later, keyed.where("rank < _last").select("doc_id", "page", "rank", "x", "y", "width", "height", "_key"), ("a", "b"), SAME_WORD).where("b.rank < a.rank")
    before = over.groupBy("doc_id", "page", F.col("a.rank").alias("rank"), F.col("a.i").alias("i")).agg(F.max((F.col("a._key") == F.col("b._key")).cast("int")).alias("_said"), F.lit(True).alias("_met"))
    before = settle(before)
    # values are looked for where they decide: in a word over others that say something else, then on its page
    other = w.select("doc_id", "page", "rank", "i", "text").join(merged(before.where("_said = 0")), ["doc_id", "page", "rank", "i"], "left_semi")
    asked = settle(other.select("doc_id", "page", "rank", "i", F.explode(_values(F.col("text"))).alias("v")))
    there = w.select("doc_id", "page", "rank", "text").join(merged(asked.select("doc_id", "page").distinct()), ["doc_id", "page"], "left_semi")
    seen = there.select("doc_id", "page", "rank", F.explode(_values(F.col("text"))).alias("v")).groupBy("doc_id", "page", "v").agg(F.min("rank").alias("_first"))
    new = asked.join(merged(seen), ["doc_id", "page", "v"]).where("rank = _first").groupBy("doc_id", "page", "rank", "i").agg(F.lit(True).alias("_new"))
    d = w.join(merged(before), ["doc_id", "page", "rank", "i"], "left").join(merged(new), ["doc_id", "page", "rank", "i"], "left")
    keep = (F.col("rank") == 1) | F.col("_met").isNull() | ((F.col("_said") == 0) & F.coalesce("_new", F.lit(False)))
    kept = settle(d.where(keep).select(*words.columns, "confidence"))  # both results read it
    used = kept.groupBy("doc_id", "page").agg(F.min("confidence").alias("confidence"))
    return kept.select(words.columns), used.withColumn("human_review", F.col("confidence") < REVIEW)


def more_attempts(confidences: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """(doc_id, page, attempts, again): whether a page is to be read once more, and at what resolution: 300 dots, 100 more each time, 600 at most."""
    d = confidences.groupBy("doc_id", "page").agg(F.count("*").alias("attempts"), F.max("confidence").alias("best"))
    again = (F.col("attempts") < most) & ((F.col("attempts") < least) | (F.col("best") < SURE))
    return d.select("doc_id", "page", "attempts", again.alias("again"), F.when(again, F.least(300 + 100 * F.col("attempts"), F.lit(600)).cast("int")).alias("dpi"))


def boxes_of(spans: DataFrame, words: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of the words that each span (doc_id, s, e) touches, and spans of which some character but white space has no box."""
    def strips(df: DataFrame, name: str) -> DataFrame:
        first, last = F.floor(F.col("s") / STRIP), F.floor(F.greatest(F.col("e") - 1, F.col("s")) / STRIP)
        return df.select("doc_id", *(F.col(c).alias(f"_{name}_{c}") for c in df.columns if c != "doc_id"), first.alias(f"_{name}_first"), F.explode(F.sequence(first, last)).alias("_strip"))

    met = strips(spans.select("doc_id", "s", "e"), "a").join(strips(words.select("doc_id", "s", "e", "page", "x", "y", "width", "height"), "b"), ["doc_id", "_strip"])
    met = met.where((F.col("_strip") == F.greatest("_a_first", "_b_first")) & (F.col("_b_s") < F.col("_a_e")) & (F.col("_a_s") < F.col("_b_e")))
    boxes = (F.col(f"_b_{c}").alias(c) for c in ("page", "x", "y", "width", "height"))
    rows = met.select("doc_id", F.col("_a_s").alias("s"), F.col("_a_e").alias("e"), *boxes, F.greatest("_a_s", "_b_s").alias("_s"), F.least("_a_e", "_b_e").alias("_e"))
    value = F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s"))
    solid = F.length(F.regexp_replace(value, r"(?U)\s", ""))
    piece = F.length(F.regexp_replace(F.substring(F.col("text"), F.col("_s") + 1, F.col("_e") - F.col("_s")), r"(?U)\s", ""))
    have = rows.join(texts, "doc_id").groupBy("doc_id", "s", "e").agg(F.sum(piece).alias("_n"))
    bare = spans.select("doc_id", "s", "e").distinct().join(texts, "doc_id").join(have, ["doc_id", "s", "e"], "left").where(solid > F.coalesce("_n", F.lit(0))).select("doc_id", "s", "e")
    return rows.drop("_s", "_e"), bare
