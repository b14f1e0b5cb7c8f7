"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where the hash has enough zero bits. Chunk sizes are normalised:
below the wanted size a boundary needs more zero bits, above it fewer. Boundaries depend on the last 32 bytes alone, so they find
their places again after an insertion. The fingerprint is the set of chunk digests, each weighted by its bytes; how much of that
weight lies in another fingerprint measures containment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._text import U
from ._util import text_of

LEAST, WANTED, MOST = 12, 32, 128  # bytes
STRICT, EASY = U(0x3F) << U(58), U(0x0F) << U(60)  # 1 in 64 before the wanted size, 1 in 16 after
_rng = np.random.Generator(np.random.PCG64(977))
GEAR = _rng.integers(0, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
WINDOW = 32
_BLOCK = 1 << 20


def gear(buf: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last 32 bytes of GEAR[byte] << age, by doubling the window five times."""
    h = GEAR[buf]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << U(width)
        width *= 2
    return h


def chunk_ends(buf: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text's bytes, the last at its end."""
    n = len(buf)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    easy = []
    strict = []
    for at in range(0, n, _BLOCK):
        lo = max(0, at - WINDOW + 1)
        h = gear(buf[lo : at + _BLOCK])[at - lo :]
        e = np.flatnonzero(h & EASY == 0)
        easy.append(e + at + 1)
        strict.append(e[h[e] & STRICT == 0] + at + 1)
    easy, strict = np.concatenate(easy).tolist(), np.concatenate(strict).tolist()
    ends, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        lo, mid, hi = at + LEAST, at + WANTED, min(at + MOST, n)
        while j < len(strict) and strict[j] < lo:
            j += 1
        if j < len(strict) and strict[j] <= min(mid, n):
            at = strict[j]
        else:
            while i < len(easy) and easy[i] <= mid:
                i += 1
            at = easy[i] if i < len(easy) and easy[i] <= hi else hi
        ends.append(at)
    if at < n:
        ends.append(n)
    return np.array(ends, np.int64)


class Fingerprint:
    """Distinct chunk digests (sorted) and the bytes of each."""

    __slots__ = ("digests", "sizes")

    def __init__(self, text: bytes):
        buf = np.frombuffer(text, np.uint8)
        ends = chunk_ends(buf)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        digests = _text.word_hashes(buf, starts, ends) >> U(24)  # 40 bits
        self.digests, first = np.unique(digests, return_index=True)
        self.sizes = (ends - starts)[first]

    def __str__(self) -> str:
        """digest:bytes, in order, 10 and as many hex digits as it takes."""
        return ",".join(f"{d:010x}:{s:x}" for d, s in zip(self.digests.tolist(), self.sizes.tolist()))

    def containment(self, other: Fingerprint) -> float:
        """The share of this one's weight that the other has too; of an empty one 1.0 in an empty one, else 0.0."""
        total = int(self.sizes.sum())
        if not total:
            return float(not len(other.sizes))
        if not len(other.digests):
            return 0.0
        at = np.searchsorted(other.digests, self.digests)
        same = other.digests[np.minimum(at, len(other.digests) - 1)] == self.digests
        return float(self.sizes[same].sum() / total)


def fingerprints(docs: DataFrame, text_column: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of docs and the fingerprint as a string; a column of that name is replaced. Null and empty texts have the empty
    string. No shuffle."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: str(Fingerprint(t.encode("utf-8", "surrogatepass"))))

    return docs.withColumn(out, run(text_of(text_column)))


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def range_of(value, bounds: list[int]):
    """How many of the sorted bounds are at most value, by binary search."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(b) for b in bounds])

    def step(s, _):
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        above = F.element_at(edges, F.least(mid + 1, F.lit(len(bounds)))) > value
        return F.struct(F.when((s.lo < s.hi) & ~above, mid + 1).otherwise(s.lo).alias("lo"), F.when((s.lo < s.hi) & above, mid).otherwise(s.hi).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, step, lambda s: s.lo)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, copy, doc_id, text), dealt so that each part holds a range of ids in order, then a copy of the next part's first row.

    One shuffle of the texts. The bounds of the ranges come from the ids alone; the driver holds one for each part, of which there are
    as many as splits or shuffle partitions. Rows with equal ids follow each other by a hash of the text, and an id with more rows than
    a part takes several; null ids come first. copy: 0 own, 1 next part's first, 2 the first of all, after the last.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text_of().alias("text"))
    n = parts or max(base.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = sorted(int(x) for x in base.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n)) if n > 1 else []
    bounds = sorted(set(quantiles))
    part = range_of(F.col("id"), bounds) * F.lit(n + 1).cast("long")
    # ids that are the bound of several ranges have more rows than one part: those are dealt on by the hash of the text
    hot = {b: quantiles.count(b) for b in bounds if quantiles.count(b) > 1}
    keyed = base.withColumn("h", F.xxhash64("text") if hot else F.lit(0).cast("long"))
    if hot:
        pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("id")), F.lit(1))
        own = F.floor((F.col("h").cast("double") / float(2**64) + 0.5) * pieces).cast("long")
        first_of = F.when(pieces > 1, F.least(own, pieces - 1)).otherwise(F.when(F.element_at(F.create_map(*[F.lit(x) for b in hot for x in (bounds.index(b) + 1, n)]), range_of(F.col("id"), bounds)).isNotNull(), F.lit(n)).otherwise(0))
        part = part + first_of
    keyed = keyed.withColumn("part", part)
    heads = sorted(((r.part, r.h.id, r.h.h) for r in keyed.groupBy("part").agg(F.min(F.struct("id", "h")).alias("h")).collect()))  # one row for each part
    place = {p: i for i, (p, _, _) in enumerate(heads)}
    copies = [(i, h, place[heads[k - 1][0]], 1 if k else 2) for k, (_, i, h) in enumerate(heads)]
    copies = spark.createDataFrame(copies, "id long, h long, to int, copy int")
    number = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("part")) if place else F.lit(0)
    own = keyed.select(number.alias("part"), F.lit(0).alias("copy"), "id", "h", "text")
    extra = keyed.drop("part").join(F.broadcast(copies), ["id", "h"]).groupBy(F.col("to").alias("part"), "copy", "id", "h").agg(F.min("text").alias("text"))  # one row for each part
    dealt = own.unionByName(extra)
    return dealt.repartitionById(max(1, len(heads)), F.col("part")).sortWithinPartitions("part", "copy", "id", "h", "text")


def edit_report(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited text, and how much of the first lies in the second and in the next document's.

    The next document is the one of next higher doc_id, equal ids by a hash of the text; the first follows the last. Null texts are
    empty, empty ones have the empty fingerprint, texts of any length are read whole. Null ids come first and are returned as null.
    Equal texts have equal fingerprints. An empty table gives an empty result. Further columns are ignored, whatever their names.
    """

    def run(frames):
        import hashlib

        held = None

        def row(doc, text, fp, after, after_fp):
            e = edited(text, after).encode("utf-8", "surrogatepass")
            ef = Fingerprint(e)
            return (doc if doc != -(2**63) else None, len(text), hashlib.sha256(e).hexdigest(), str(fp), str(ef), fp.containment(ef), fp.containment(after_fp))

        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in _text.batches(frames):
            out = []
            for c, doc, text in zip(*(batch.column(x).to_pylist() for x in ("copy", "id", "text"))):
                if c and held is None:
                    continue  # one copy is enough
                fp = Fingerprint(text.encode("utf-8", "surrogatepass"))
                if held is not None:
                    out.append(row(*held, text, fp))
                held = None if c else (doc, text, fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return with_next(docs).mapInArrow(run, SCHEMA)
