"""Around a tagger: sentence chunks, decoding of BIO tags, labels, and a stable interface for models.

No Thai model or tokenizer is part of this library: a tagger is any function from a text to (word, tag) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the labels of public Thai taggers mean here.
LABELS = {"PERSON": "NAME", "ORGANIZATION": "ORGANIZATION", "LOCATION": "LOCATION", "DATE": "DATE", "PER": "NAME", "ORG": "ORGANIZATION", "LOC": "LOCATION", "DTM": "DATE"}


MAX_PROTOTYPES = 64


def decode(tokens: DataFrame, doc: str = "doc_id", place: str = "i", s: str = "s", e: str = "e", tag: str = "tag") -> DataFrame:
    """(doc, s, e, label) from token rows with B-X, I-X or O: an I- continues only its own label; one that stands alone is nothing.

    Islands: a token that continues has the number of the B- before it, and the run breaks where the label changes or an O stands.
    """
    w = Window.partitionBy(doc).orderBy(place)
    label = F.regexp_extract(tag, "^[BI]-(.+)$", 1)
    t = tokens.withColumns({"_label": label, "_begin": F.col(tag).startswith("B-")})
    t = t.withColumns({"_last": F.lag("_label").over(w), "_open": F.lag(tag).over(w)})
    broken = F.col("_begin") | (F.col(tag) == "O") | (F.col("_label") != F.coalesce("_last", F.lit(""))) | (F.coalesce("_open", F.lit("O")) == "O")
    t = t.withColumn("_run", F.sum(F.when(broken, 1).otherwise(0)).over(w))
    runs = t.where(F.col("_label") != "").groupBy(doc, "_run").agg(F.min(s).alias("s"), F.max(e).alias("e"), F.first("_label").alias("label"), F.max("_begin").alias("_b"))
    return runs.where("_b").select(doc, "s", "e", "label")


def data_types(rows: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """data_type of each row's label; rows of other labels go."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return rows.withColumn("data_type", F.element_at(known, F.col("label"))).where("data_type IS NOT NULL")


def hygiene(rows: DataFrame) -> DataFrame:
    """Drops values of one character and organisations in Latin letters alone."""
    return rows.where((F.length("value") >= 2) & ~((F.col("data_type") == "ORGANIZATION") & F.col("value").rlike(r"^[A-Za-z0-9 .,&'-]+$")))


def chunks(sentences: DataFrame, core: int = 500, doc: str = "doc_id") -> DataFrame:
    """(doc, chunk, s, e): consecutive sentences (doc, i, s, e) up to core characters together, one at least."""
    per = sentences.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("i", "s", "e"))).alias("_x"))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.coalesce(x.e - last.s, F.lit(core + 1)) <= core)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.s.alias("s"), x.e.cast("int").alias("e"))))).otherwise(F.concat(acc, F.array(F.struct(x.s.cast("int").alias("s"), x.e.cast("int").alias("e")))))

    return per.select(doc, F.posexplode(F.aggregate("_x", empty, add)).alias("chunk", "c")).select(doc, "chunk", "c.*")


def tag(docs: DataFrame, load: Callable[[], Callable[[str], list[tuple[str, str]]]], text_column: str = "text", fail_closed: bool = False) -> DataFrame:
    """docs with tokens: array<struct<word, tag>> and skipped: whether the tagger failed on the text.

    load is called once for each Python worker. fail_closed: a failure ends the job, so that no text passes with partial results.
    """
    out = T.StructType([T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("tag", T.StringType())]))), T.StructField("skipped", T.BooleanType())])

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for texts in batches:
            rows = []
            for text in texts:
                try:
                    rows.append(([{"word": w, "tag": t} for w, t in tagger(text or "")], False))
                except Exception:
                    if fail_closed:
                        raise
                    rows.append(([], True))
            yield pd.DataFrame({"tokens": [r[0] for r in rows], "skipped": [r[1] for r in rows]})

    # a model is dear: Spark must not move it before the filters and joins that select what is tagged
    return docs.withColumn("_t", run.asNondeterministic()(F.col(text_column))).withColumns({"tokens": F.col("_t.tokens"), "skipped": F.col("_t.skipped")}).drop("_t")


def nearest_prototype(rows: DataFrame, prototypes: DataFrame, least: float = 0.55, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(id, category, cosine) of the closest prototype where it is close enough. Prototypes: (category, vector), a fixed short list."""
    known = [(r[0], [float(x) for x in r[1]]) for r in prototypes.select("category", "vector").limit(MAX_PROTOTYPES + 1).collect()]
    if len(known) > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes: they are expressions of the plan, join a table instead")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    v = F.col(vector).cast("array<double>")
    sims = F.array(*[F.struct((F.aggregate(F.zip_with(v, F.array(*map(F.lit, p)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / (norm(v) * F.lit(sum(x * x for x in p) ** 0.5))).alias("cosine"), F.lit(c).alias("category")) for c, p in known])
    return rows.select(id_column, F.array_max(sims).alias("b")).where(F.col("b.cosine") >= least).select(id_column, "b.category", "b.cosine")
