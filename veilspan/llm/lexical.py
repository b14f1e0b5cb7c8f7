"""Ranked lexical search: three-phase uniform thresholds (TPUT) over posting lists that are partitioned by term.

Texts are read once for each block of items. The postings of the block's terms are packed by runs of documents (blocks) and dealt by term;
long lists are split over partitions. With all lists' scores at hand:

1. The head of each list, its TOP largest contributions, gives lower bounds: an item's bound is its TOP-th largest partial sum.
2. An item with m terms fetches all contributions of bound / m and more. A document without such a one scores less than the bound. What is
   fetched meets by blocks of documents; partial sums and what the other lists may still add decide which documents stay.
3. For these, what was not fetched is looked up in the same lists, and exact scores are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._util import batch_bytes, discard, materialize

TOP = 50
BLOCK_BYTES = 4 << 20  # of the texts whose postings travel together
BLOCK_TERMS = 50_000  # terms of the items that are searched together; one item may have more
POSTING = np.dtype([("row", "<u2"), ("tf", "<u4"), ("n", "<u4")])
LISTS = "term int, block long, postings binary, n_documents long, n_terms long"
DOCUMENTS = -1  # the "term" under which a block's doc_ids and totals travel

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, in order, and the first term of each text (n + 1 numbers)."""
    buf, offs = _text.raw(texts)
    starts, ends, first = _text.runs(_INSIDE[buf], offs)
    return _text.as_strings(_text.LOWER[buf], starts, ends), first


def _items(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[dict[int, list[str]]]:
    """Blocks of items with their distinct terms, of most terms in a block or of one item."""

    def split(it):
        for batch in it:
            terms, first = _terms(batch.column(1))
            lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), terms)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(pa.list_(pa.string()))], ["item_id", "terms"])

    rows = items.where("item_id IS NOT NULL").select("item_id", F.col("text").cast("string")).mapInArrow(split, "item_id long, terms array<string>")
    rows = rows.select("item_id", F.explode("terms").alias("t")).groupBy("item_id").agg(F.array_sort(F.collect_set("t")).alias("terms")).orderBy("item_id")
    block, size = {}, 0
    for row in rows.toLocalIterator():
        if block and size + len(row.terms) > most:
            yield block
            block, size = {}, 0
        block[row.item_id] = row.terms
        size += len(row.terms)
    if block:
        yield block


def _indexer(vocabulary: list[str], block_bytes: int):
    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        made, waiting, size, n_rows = 0, [], 0, 0

        def block():
            nonlocal made
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            ids, counts, terms, rows = [], [], [], []
            at = 0
            for id_array, count, term, row in waiting:
                ids.append(id_array)
                counts.append(count)
                terms.append(term)
                rows.append(row + at)
                at += len(count)
            counts, terms = np.concatenate(counts), np.concatenate(terms)
            both, tf = np.unique(terms.astype(np.int64) << 16 | np.concatenate(rows), return_counts=True)
            packed = np.empty(len(both), POSTING)
            packed["row"], packed["tf"], packed["n"] = both & 0xFFFF, tf, counts[both & 0xFFFF]
            term, first = np.unique(both >> 16, return_index=True)
            edges = np.append(first, len(both)) * POSTING.itemsize
            lists = pa.Array.from_buffers(pa.large_binary(), len(term), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())
            zero = np.zeros(len(term), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(zero + number), lists, pa.array(zero), pa.array(zero)], ["term", "block", "postings", "n_documents", "n_terms"])
            ids = pa.concat_arrays(ids)
            names = ids.fill_null(0).to_numpy().tobytes() + ids.is_valid().to_numpy(zero_copy_only=False).tobytes()
            total = [[DOCUMENTS], [number], [names], [int((counts > 0).sum())], [int(counts.sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(total, (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["term", "block", "postings", "n_documents", "n_terms"])

        for batch in _text.batches(it):
            if waiting and (size + batch.nbytes > block_bytes or n_rows + batch.num_rows > 65_535):
                yield from block()
                waiting, size, n_rows = [], 0, 0
            found, first = _terms(batch.column(1))
            at = pc.index_in(found, value_set=known)
            hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            waiting.append((batch.column(0), np.diff(first), at.drop_null().to_numpy(), np.searchsorted(first, hit, "right") - 1))
            size += batch.nbytes
            n_rows += batch.num_rows
        if waiting:
            yield from block()
        _text.give_back()

    return index


class _Scorer:
    """A block's items and terms, with weights and, from phase 2 on, bounds: small arrays that go to every task."""

    def __init__(self, items: dict[int, list[str]], vocabulary: list[str], n: int, total: int, df: dict[int, int]):
        self.n, self.total = n, total
        place = {t: i for i, t in enumerate(vocabulary)}
        self.ids = list(items)
        self.terms = [np.array([place[t] for t in terms if place[t] in df], np.int64) for terms in items.values()]
        self.weight = np.zeros(len(vocabulary), np.int64)
        for t, count in df.items():
            self.weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * count + 1)))
        self.bound = np.zeros(len(self.ids), np.int64)
        self.least = np.zeros(len(self.ids), np.int64)  # contributions that are fetched
        self.most = np.zeros(len(vocabulary), np.int64)  # the largest contribution of a list

    def contributions(self, term, postings: np.ndarray) -> np.ndarray:
        tf, n = postings["tf"].astype(np.int64), postings["n"].astype(np.int64)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * self.n) // self.total)))

    def bounded(self, heads: list[tuple[int, int]], tops: dict[int, int]) -> None:
        for t, c in heads:
            self.most[t] = c
        for i, terms in enumerate(self.terms):
            self.bound[i] = tops.get(i, 0)
            self.least[i] = -(-self.bound[i] // max(1, len(terms)))

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each term the least and the largest threshold among the items that have it."""
        low, high = np.full(len(self.weight), np.iinfo(np.int64).max), np.zeros(len(self.weight), np.int64)
        for i, terms in enumerate(self.terms):
            low[terms] = np.minimum(low[terms], self.least[i])
            high[terms] = np.maximum(high[terms], self.least[i])
        return low, high


def _heads(scorer: _Scorer, top: int):
    """(term, block, postings) to (term, block, row, c): of each list, as far as a task has it, the top contributions."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in it:
            for term, block, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                p = np.frombuffer(raw, POSTING)
                c, rows, blocks = scorer.contributions(term, p), p["row"].astype(np.int64), np.full(len(p), block)
                if term in best:
                    c, rows, blocks = (np.concatenate(x) for x in zip(best[term], (c, rows, blocks)))
                if len(c) > top:
                    keep = np.argpartition(-c, top)[:top]
                    c, rows, blocks = c[keep], rows[keep], blocks[keep]
                best[term] = c, rows, blocks
        if best:
            sizes = [len(x[0]) for x in best.values()]
            c, rows, blocks = (np.concatenate(x) for x in zip(*best.values()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(best), sizes), pa.int32()), pa.array(blocks, pa.int64()), pa.array(rows, pa.int32()), pa.array(c, pa.int64())], ["term", "block", "row", "c"])

    return run


def _sieve(scorer: _Scorer, fetch: bool):
    """Of each packed list the postings that some item fetches, or those that some item has not fetched; doc_ids pass with the former."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = scorer.ranges()
        for batch in it:
            out = ([], [], [])
            for term, block, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if term != DOCUMENTS:
                    p = np.frombuffer(raw, POSTING)
                    c = scorer.contributions(term, p)
                    raw = p[c >= low[term] if fetch else c < high[term]].tobytes()
                if raw and (fetch or term != DOCUMENTS):
                    for x, y in zip(out, (term, block, raw)):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["term", "block", "postings"])

    return run


def _unpacked(scorer: _Scorer, terms: list[int], lists: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term to rows and contributions, of one block. A list may come in several parts."""
    parts: dict[int, list[bytes]] = {}
    for t, raw in zip(terms, lists):
        parts.setdefault(t, []).append(raw)
    out = {}
    for t, raw in parts.items():
        p = np.frombuffer(b"".join(raw), POSTING)
        out[t] = p["row"], scorer.contributions(t, p)
    return out


CANDIDATES = "item int, block long, row int, doc_id long, known long, most long"


def _candidates(scorer: _Scorer, top: int):
    """Partitions sorted by block to candidates: documents whose upper bound reaches the top-th largest lower bound seen in the task."""
    schema = pa.schema([("item", pa.int32()), ("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("known", pa.int64()), ("most", pa.int64())])

    def one(block: int, terms: list[int], lists: list[bytes], best: list[np.ndarray]) -> pa.RecordBatch:
        at = terms.index(DOCUMENTS)
        n = len(lists[at]) // 9
        ids = pa.array(np.frombuffer(lists[at], np.int64, n), mask=~np.frombuffer(lists[at], bool, n, 8 * n))
        of = _unpacked(scorer, terms[:at] + terms[at + 1 :], lists[:at] + lists[at + 1 :])
        out = []
        for i, own in enumerate(scorer.terms):
            known, seen, left = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
            for t in own:
                # what a list may add that was not fetched: less than the threshold, and not more than its head
                rest = max(0, min(int(scorer.most[t]), int(scorer.least[i]) - 1))
                left += rest
                if t in of:
                    rows, c = of[t]
                    if len(fetched := np.flatnonzero(c >= scorer.least[i])):
                        known[rows[fetched]] += c[fetched]
                        seen[rows[fetched]] += rest
            met = np.flatnonzero(known)
            if not len(met):
                continue
            sums = known[met]
            if len(sums) > top:
                sums = np.partition(sums, len(sums) - top)[-top:]
            best[i] = np.sort(np.concatenate((best[i], sums)))[-top:]
            least = max(int(scorer.bound[i]), int(best[i][0]) if len(best[i]) == top else 0)
            met = met[known[met] + left - seen[met] >= least]
            out.append((np.full(len(met), i), met, known[met], known[met] + left - seen[met]))
        item, row, known, most = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.full(len(row), block), pa.int64()), pa.array(row, pa.int32()), ids.take(pa.array(row)), pa.array(known), pa.array(most)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64) for _ in scorer.ids]
        now, terms, lists = None, [], []
        for batch in it:
            for term, block, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != now and terms:
                    yield one(now, terms, lists, best)
                    terms, lists = [], []
                now = block
                terms.append(term)
                lists.append(raw)
        if terms:
            yield one(now, terms, lists, best)

    return run


def _look_up(scorer: _Scorer):
    """A block's candidates and its postings that were not fetched, to (item, doc_id, score)."""

    def run(candidates: pa.Table, lists: pa.Table) -> pa.Table:
        of = _unpacked(scorer, lists.column("term").to_pylist(), lists.column("postings").to_pylist())
        item, row, score = (candidates.column(c).to_numpy().astype(np.int64) for c in ("item", "row", "known"))
        for i in np.unique(item):
            own = np.flatnonzero(item == i)
            add = np.zeros(1 << 16, np.int64)
            for t in scorer.terms[i]:
                if t in of:
                    rows, c = of[t]
                    add[rows] += np.where(c < scorer.least[i], c, 0)
            score[own] += add[row[own]]
        return pa.table({"item": pa.array(item, pa.int32()), "doc_id": candidates.column("doc_id"), "score": pa.array(score, pa.int64())})

    return run


def _first(rows: DataFrame, by: str, top: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: dict[int, list[str]], top: int, block_bytes: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({t for terms in items.values() for t in terms})
    lists = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_indexer(vocabulary, block_bytes), LISTS)
    lists = materialize(lists.hint("rebalance", "term"))
    totals = lists.where(F.col("term") == DOCUMENTS).agg(F.sum("n_documents"), F.sum("n_terms")).first()
    held = lists.where(F.col("term") != DOCUMENTS).select("term", "block", "postings")
    df = {r.term: r.df for r in held.groupBy("term").agg(F.sum(F.length("postings") / POSTING.itemsize).cast("long").alias("df")).collect()}  # the block's terms
    if not df:
        discard(lists)
        return None
    scorer = _Scorer(items, vocabulary, totals[0], totals[1], df)

    heads = materialize(_first(held.mapInArrow(_heads(scorer, top), "term int, block long, row int, c long"), "term", top, F.desc("c")))
    owners = spark.createDataFrame([(i, int(t)) for i, terms in enumerate(scorer.terms) for t in terms], "item int, term int")
    partial = heads.join(F.broadcast(owners), "term").groupBy("item", "block", "row").agg(F.sum("c").alias("known"))  # owners: the block's terms
    tops = {r["item"]: r["known"] for r in _first(partial, "item", top, F.desc("known")).where(F.col("rank") == top).collect()}
    scorer.bounded([(r["term"], r["c"]) for r in heads.groupBy("term").agg(F.max("c").alias("c")).collect()], tops)
    discard(heads)

    fetched = lists.select("term", "block", "postings").mapInArrow(_sieve(scorer, True), "term int, block long, postings binary")
    candidates = materialize(fetched.repartition("block").sortWithinPartitions("block").mapInArrow(_candidates(scorer, top), CANDIDATES))
    # of each item the top-th largest sum that is known: what cannot reach it goes
    reach = spark.createDataFrame([(r["item"], r["known"]) for r in _first(candidates, "item", top, F.desc("known")).where(F.col("rank") == top).select("item", "known").collect()], "item int, reach long")
    left = candidates.join(F.broadcast(reach), "item", "left").where("reach IS NULL OR most >= reach").drop("reach")  # one row for each item of the block
    rest = held.mapInArrow(_sieve(scorer, False), "term int, block long, postings binary").join(left.select("block").distinct(), "block", "left_semi")
    scored = left.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(_look_up(scorer), "item int, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(scorer.ids)), "item int, item_id long")
    result = materialize(_first(scored.where("score > 0"), "item", top, F.desc("score"), F.asc_nulls_last("doc_id")).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    discard(candidates, lists)
    return result


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item (item_id, text) its top documents (doc_id, text) by score, equal scores by doc_id.

    Each row of docs is a document, also where rows share an id or a text; null ids come last among equal scores. Null and empty texts
    have no terms: such documents are never found and do not count, such items have no rows. Rows of items that share an id are one item
    with the terms of all; null item_ids are left out. Very long texts are met whole. Empty tables give no rows. Other columns are not read.
    """
    spark, found = docs.sparkSession, []
    with batch_bytes(spark):
        for block in _items(items, block_terms):
            if (rows := _search_block(docs, block, top, block_bytes)) is not None:
                found.append(rows)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
