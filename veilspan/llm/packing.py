"""Best-fit packing into several permitted sequence lengths.

Items (whole documents, or pieces of those longer than the largest length) are dealt at random into shards of bounded size and
packed there, longest first. An item goes to the open bin that it leaves fullest; if none has room, a bin opens whose size costs
least for each token if items of this length filled it. When all items are placed, every bin shrinks to the smallest permitted
length that holds its contents. Nothing is cut off or dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import discard, materialize, text_of

CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 32  # tokens that one more sequence costs, whatever its length
SHARD_ITEMS = 50_000
SCHEMA = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_capacity int, bin_offset int"


def opening_sizes(capacities: Sequence[int], overhead: int) -> np.ndarray:
    """For each item length from 0: the bin size that costs least for each token if such items filled it; ties to the larger."""
    caps = np.array(sorted(capacities))
    length = np.arange(caps[-1] + 1)[:, None]
    useful = np.where(caps >= np.maximum(length, 1), (caps // np.maximum(length, 1)) * np.maximum(length, 1), 0)
    cost = np.where(useful > 0, (caps + overhead) / np.maximum(useful, 1), np.inf)
    return caps[len(caps) - 1 - np.argmin(cost[:, ::-1], axis=1)]


def pack_items(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and the bin's final capacity for each item. Lengths are at most the largest capacity."""
    caps = np.array(sorted(set(capacities)))
    opens = opening_sizes(caps, overhead)
    lengths = np.asarray(lengths, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}  # residual -> open bins
    some = 0  # bit r is set if a bin has residual r
    size: list[int] = []
    left: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fitting = some >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            b, r = len(size), int(opens[n])
            size.append(r)
            left.append(r)
        bins[i], offsets[i] = b, size[b] - r
        left[b] = r - n
        if r > n:
            room.setdefault(r - n, []).append(b)
            some |= 1 << (r - n)
    used = np.array(size, np.int64) - np.array(left, np.int64)
    final = caps[np.searchsorted(caps, used)] if len(size) else used
    return bins, offsets, final[bins] if len(bins) else bins


def word_count(column: str | Column = "text") -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+"))


def pack(items: DataFrame, id_column: str = "doc_id", length_column: str = "n_tokens", capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row for each item, or for each piece of an item longer than the largest capacity: where it lies.

    Null or negative lengths count as 0; empty items take no room but still get a bin. Null and repeated ids are packed row by row.
    Shards hold about shard_items pieces, also where they are those of a few very long items. Ties of length go by row. An empty table gives an empty result. Further columns of items are ignored, whatever their names.
    """
    top = max(capacities)
    n = F.greatest(F.coalesce(F.col(length_column).cast("long"), F.lit(0)), F.lit(0))
    rows = materialize(items.select(F.col(id_column).cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row")))
    last = F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0))
    shards = max(1, -(-(rows.agg(F.sum(last + 1)).first()[0] or 0) // shard_items))  # of pieces: a few long items have many
    pieces = rows.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    pieces = pieces.select(
        "doc_id", "piece", "row", (F.col("piece").cast("long") * top).alias("start"),
        F.least(F.col("n") - F.col("piece").cast("long") * top, F.lit(top)).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
    )
    caps = tuple(capacities)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], ignore_index=True)
        b, offset, cap = pack_items(pdf.n_tokens.to_numpy(), caps, overhead)
        return pd.DataFrame({"doc_id": pdf.doc_id, "piece": pdf.piece, "start": pdf.start, "n_tokens": pdf.n_tokens, "bin_id": (int(key[0]) << 32) + b, "bin_capacity": cap, "bin_offset": offset})

    out = materialize(pieces.groupBy("shard").applyInPandas(run, SCHEMA))
    discard(rows)
    return out


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Packs texts; a document takes its words and one end mark. Null and empty texts take the mark alone. For a model's own lengths give
    pack() the number of ids that its tokenizer makes."""
    return pack(docs.select("doc_id", (word_count("text") + 1).alias("n_tokens")), **options)
