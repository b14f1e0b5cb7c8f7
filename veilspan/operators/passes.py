"""A tagger in two passes: what the first pass makes of chunks, and line by line what it got wrong or could not see.

1. Texts are cut into strides of sentences and tagged. Only spans that begin in a stride's core count.
2. Lines are tagged again, each alone, where the first pass shows that the tagger lost its way: a stride that is one span which covers it
   and says nothing; a span of a label that nobody knows, over several lines. And short lines that look like a name and hold nothing, or
   nothing but a name: there a second name is taken, or one that goes on further to the right.

Each pass is one job over rows of text pieces, so only the lines that are selected are tagged twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.layout import each, settle
from . import names, tagging

Tagger = Callable[[str], list[tuple[str, str]]]
LOST_SHARE, LOST_LINES = 0.8, 3  # of a stride's core that one span covers; lines that no entity runs over
MOST_LINE = 80  # characters of a short line, which is tried again
SCORE = 0.85
_SPANS = "array<struct<s:int,e:int,label:string>>"
_SHAPE = "^[ \t]*[ก-๛]{2,25}[ \t]+[ก-๛]{2,25}[ \t]*$"


def spans_of(text: str, tokens: list[tuple[str, str]]) -> list[dict]:
    """Spans of a text from its words with BIO tags: an I- continues only its own label, one that stands alone is nothing. Words are
    looked for in order; one that is not there is passed over."""
    out, at, open_label = [], 0, None
    for word, tag in tokens:
        s = text.find(word, at) if word else -1
        if s < 0:
            continue
        at = s + len(word)
        kind, _, label = tag.partition("-")
        if kind == "B":
            out.append({"s": s, "e": at, "label": label})
            open_label = label
        elif kind == "I" and label == open_label:
            out[-1]["e"] = at
        elif word.strip():
            open_label = None
    return out


def tag_pieces(pieces: DataFrame, load: Callable[[], Tagger], fail_closed: bool = False) -> DataFrame:
    """pieces (…, piece: text) with found: spans in the piece. A failure gives none, or ends the job."""
    tagged = tagging.tag(pieces, load, "piece", fail_closed)

    @F.pandas_udf(_SPANS)
    def run(texts: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([spans_of(t or "", [(x["word"], x["tag"]) for x in ts]) for t, ts in zip(texts, tokens)], dtype=object)

    return tagged.withColumn("found", run("piece", "tokens")).drop("tokens", "skipped")


def _moved(tagged: DataFrame, id_column: str, *more: str) -> DataFrame:
    """A row for each span, at its place in the text; at: where the piece begins."""
    rows = each(tagged, "found", id_column, "at", *more, name="x")
    return rows.select(id_column, (F.col("x.s") + F.col("at")).alias("s"), (F.col("x.e") + F.col("at")).alias("e"), F.col("x.label").alias("label"), *more)


def _lines(docs: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """(id, s, e, piece) of the lines that hold more than white space."""
    lines = docs.select(F.col(id_column), F.explode(X.spans(F.coalesce(F.col(text_column), F.lit("")), r"[^\r\n]+")).alias("x"))
    return lines.select(id_column, "x.s", "x.e", F.col("x.value").alias("piece")).where(F.col("piece").rlike(r"(?U)\S"))


def kept(docs: DataFrame, rows: DataFrame, text_column: str, id_column: str, labels: dict[str, str], retried: bool = False) -> DataFrame:
    """(id, s, e, data_type) of span rows (id, s, e, label): known labels, long enough, names cleaned and cut, types told by cues.

    retried: names that are nothing but labels and roles, which a tagger makes of lines without their neighbours, go too.
    """
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    rows = rows.withColumn("data_type", F.element_at(known, F.col("label"))).where("data_type IS NOT NULL AND e - s >= 2")
    texts = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    own = rows.groupBy(id_column).agg(F.collect_list(F.struct("s", "e", "data_type")).alias("_x")).join(texts, id_column)
    kind = "array<struct<s:int,e:int,data_type:string>>"

    @F.pandas_udf(kind)
    def clean(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, x):
            if x["data_type"] == "NAME":
                places = names.hygiene(t, x["s"], x["e"])
                return [(s, e) for s, e in places if not retried or not all(w in V.NOT_NAMES or w in V.NAME_STOPS for w in t[s:e].split())]
            if x["data_type"] == "ORGANIZATION" and not any("฀" <= c <= "๿" for c in t[x["s"] : x["e"]]):
                return []
            return [(x["s"], x["e"])]

        return pd.Series([[{"s": s, "e": e, "data_type": x["data_type"]} for x in xs for s, e in one(t, x)] for t, xs in zip(text, spans)], dtype=object)

    out = each(own, clean("_text", "_x"), id_column, "_text", name="x").select(id_column, "_text", "x.*")
    return names.upgrade(out, "_text").drop("_text").distinct()


def tag_twice(docs: DataFrame, load: Callable[[], Tagger], text_column: str = "text", id_column: str = "doc_id", labels: dict[str, str] = tagging.LABELS, core: int = 500, margin: int = 1, fail_closed: bool = False) -> DataFrame:
    """(id, s, e, data_type, score) of a tagger's spans, after both passes. labels: what the tagger's labels mean; null for those that
    are known to mean nothing here. Texts have ids of their own; null and empty texts have no spans."""
    meant = {k: v for k, v in labels.items() if v}
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = docs.select(F.col(id_column), text.alias(text_column))
    sentences = names.sentences(own, text_column, id_column)
    strides = names.stride(sentences, core, margin, id_column).join(own, id_column)
    pieces = strides.select(id_column, "chunk", F.col("s").alias("at"), "core_s", "core_e", F.substring(F.col(text_column), F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"))
    first = settle(tag_pieces(pieces, load, fail_closed))  # tagged once, read by both passes

    one = F.element_at("found", 1)
    shared = F.least(one["e"] + F.col("at"), F.col("core_e")) - F.greatest(one["s"] + F.col("at"), F.col("core_s"))
    over = F.size(F.split(F.substring(F.col("piece"), one["s"] + 1, one["e"] - one["s"]), "\n")) >= LOST_LINES
    lost = (F.size("found") == 1) & (F.col("core_e") > F.col("core_s")) & (shared >= LOST_SHARE * (F.col("core_e") - F.col("core_s"))) & (~one["label"].isin(*meant) | over)
    lost = F.when(F.size("found") == 1, F.coalesce(lost, F.lit(False))).otherwise(F.lit(False))
    good = _moved(first.where(~lost), id_column, "core_s", "core_e").where("s >= core_s AND s < core_e")
    texts = good.join(own, id_column)
    unknown = ~F.col("label").isin(*labels) & F.substring(F.col(text_column), F.col("s") + 1, F.col("e") - F.col("s")).contains("\n")
    strange = texts.where(unknown).select(id_column, "s", "e")
    good = texts.where(~unknown).select(id_column, "s", "e", "label")

    lines = _lines(own, text_column, id_column)
    ranges = first.where(lost).select(F.col(id_column).alias("_d"), F.col("core_s").alias("_s"), F.col("core_e").alias("_e"))
    meets = lambda r: (F.col(id_column) == F.col("_d")) & (F.col("s") < F.col("_e")) & (F.col("_s") < F.col("e"))
    odd = strange.select(F.col(id_column).alias("_d"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    again = lines.join(ranges.unionByName(odd), meets(None), "left_semi").select(id_column, F.col("s").alias("at"), "piece")
    second = _moved(tag_pieces(again, load, fail_closed), id_column).select(id_column, "s", "e", "label")
    found = settle(kept(own, good, text_column, id_column, meant).unionByName(kept(own, second, text_column, id_column, meant, True)).distinct())

    # short lines alone: nothing there yet, or names only
    there = found.select(F.col(id_column).alias("_d"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("data_type").alias("_kind"))
    short = lines.where((F.length("piece") <= MOST_LINE) & F.col("piece").rlike(_SHAPE))
    held = short.join(there, meets(None), "left").groupBy(id_column, "s", "e", "piece").agg(F.max(F.col("_kind").isNotNull() & (F.col("_kind") != "NAME")).alias("other"), F.array_sort(F.collect_list(F.when(F.col("_kind") == "NAME", F.struct("_s", "_e")))).alias("names"))
    tried = held.where(~F.coalesce("other", F.lit(False))).select(id_column, F.col("s").alias("at"), "piece", "names")
    alone = _moved(tag_pieces(tried, load, fail_closed), id_column, "names")
    lone = kept(own, alone.select(id_column, "s", "e", "label"), text_column, id_column, meant, True).where("data_type = 'NAME'")
    spans = lone.join(there.where("_kind = 'NAME'"), meets(None), "left").groupBy(id_column, "s", "e", "data_type").agg(F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("_s", "_e"))).alias("met"))
    lines_with_names = tried.where(F.size("names") > 0).select(F.col(id_column).alias("_d"), F.col("at").alias("_s"), (F.col("at") + F.length("piece")).alias("_e"))
    longer = (F.size("met") > 0) & F.forall("met", lambda m: (m["_s"] == F.col("s")) & (m["_e"] <= F.col("e"))) & F.exists("met", lambda m: m["_e"] < F.col("e"))
    grown = spans.where(longer).select(id_column, "s", "e", "data_type")
    new = spans.where(F.size("met") == 0).join(lines_with_names, meets(None), "left_anti").select(id_column, "s", "e", "data_type")
    over = grown.select(F.col(id_column).alias("_d"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    rest = found.where("data_type <> 'NAME'").unionByName(found.where("data_type = 'NAME'").join(over, meets(None), "left_anti"))
    return rest.unionByName(grown).unionByName(new).withColumn("score", F.lit(SCORE))


def with_tagged(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", out: str = "tagged") -> DataFrame:
    """docs with the rows of tag_twice() as an array, as structured.detect takes it."""
    per = spans.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("s", "e", "data_type", "score"))).alias(out))
    return docs.join(per, id_column, "left")
