"""Similarity join of documents on word shingles, by prefix filters under several global token orders.

1. Shingles are hashed batch by batch ("runs") and dealt by hash; each bucket counts in how many documents a shingle occurs. A
   shingle that is very common in a run travels as one count, so no bucket gathers a hot shingle's documents.
2. Only shingles of two documents or more go back to their run. A document that shares too few to have a partner is out.
3. Under an order (rarest first, ties by a hash) partners share one of the first n - ceil(t n) + 1 shingles. Each shared prefix
   shingle proposes links; a pair must share a prefix shingle under every order, each with its own ties, before it is verified.
4. Proposals first go to one representative of each shingle. Documents that are connected by then need no further comparison; all
   pairs that share a prefix shingle and are not yet connected are compared. So no link between components is lost, and large
   groups of near copies do not meet pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._text import U
from .components import components
from ._util import discard, materialize, text_of

K, NUM, DEN = 5, 80, 100  # words of a shingle; similarity NUM / DEN
ORDERS = 3
HOT_IN_RUN = 16  # a shingle of so many documents of one run travels as a count
TOKEN = U((1 << 48) - 1)
_NEEDS = lambda n, num, den: -(-n * num // den)  # noqa: E731  least overlap with any partner


def _pack(tokens: np.ndarray) -> bytes:
    """48-bit numbers as six planes of bytes, which compress well when sorted."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view(np.uint64).ravel()


def shingles(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(text, 48-bit hash) of each distinct shingle, in order of hash and text. With fewer than k words the whole sequence is one."""
    buf, offs = _text.raw(texts)
    low = _text.LOWER[buf]
    starts, ends, first = _text.split(low, offs)
    words = _text.word_hashes(low, starts, ends)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n)
    g = _text.grams(words, k)
    inside = owner[: len(g)] == owner[k - 1 :] if len(g) else np.zeros(0, bool)
    rows, toks = [owner[: len(g)][inside]], [g[inside]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        rows.append(np.array([i]))
        toks.append(np.array([_text.whole(words[first[i] : first[i + 1]])], np.uint64))
    row, tok = np.concatenate(rows), np.concatenate(toks) & TOKEN
    order = np.argsort(tok, kind="stable") if len(rows) == 1 else np.lexsort((row, tok))
    row, tok = row[order], tok[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (row[1:] != row[:-1])
    return row[new], tok[new]


_KEYED = "key long, run long, kind int, a binary, b binary"
_KEYED_TYPES = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _emit(name: int, ids: np.ndarray, n: np.ndarray, sigs: np.ndarray, row: np.ndarray, tok: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A run's rows (key, run, kind, a, b) from its documents and (row, tok) in order of tok: what goes to buckets, and what only the
    run itself needs (kinds 0 and 1)."""
    out = [(-1 - name, name, 0, ids.tobytes(), np.concatenate([n, *sigs]).tobytes())]
    at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(tok)))
    hot = count >= HOT_IN_RUN
    mine = np.repeat(hot, count)
    if hot.any():
        out.append((-1 - name, name, 1, _pack(tok[mine]), row[mine].astype(np.uint16).tobytes()))
    bounds = (np.arange(1, buckets, dtype=np.float64) * (2.0**48 / buckets)).astype(np.uint64)
    for kind, t, rest in ((2, tok[~mine], row[~mine].astype(np.uint16)), (3, tok[at[hot]], count[hot].astype(np.uint32))):
        cut = np.concatenate([[0], np.searchsorted(t, bounds), [len(t)]])
        for b in np.flatnonzero(np.diff(cut)).tolist():
            out.append((b, name, kind, _pack(t[cut[b] : cut[b + 1]]), rest[cut[b] : cut[b + 1]].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _KEYED_TYPES.types)], schema=_KEYED_TYPES)


def _name(number: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) + number


def _runs(buckets: int, k: int):
    """Batches of (doc_id, text) to keyed rows."""

    def run(frames):
        number = 0
        for whole in frames:
            for batch in _text.batches([whole]):
                row, tok = shingles(batch.column("text"), k)
                n = np.bincount(row, minlength=batch.num_rows)
                edge = np.concatenate([[0], np.cumsum(n)])
                mine, sigs = tok[np.argsort(row, kind="stable")], []
                for odd in (_text.ODD[6], _text.ODD[7]):  # two sums: sets are equal where 128 bits are
                    sums = np.zeros(len(row) + 1, np.uint64)
                    np.cumsum(_text.mix(mine * odd + odd), out=sums[1:])
                    sigs.append(_text.mix(sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
                ids = batch.column("doc_id").cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                yield _emit(_name(number), ids, n.astype(np.int64), np.stack(sigs), row, tok, buckets)
                number += 1

    return run


def _reruns(buckets: int):
    """Batches of (doc_id, n, tokens) to keyed rows."""

    def run(frames):
        number = 0
        for whole in frames:
            for batch in _text.batches([whole]):
                sets = [_unpack(x) for x in batch.column("tokens").to_pylist()]
                row, tok = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([*sets, np.zeros(0, np.uint64)])
                order = np.argsort(tok, kind="stable")
                n = batch.column("n").to_numpy(zero_copy_only=False)
                yield _emit(_name(number), batch.column("doc_id").to_numpy(zero_copy_only=False), n, np.zeros((2, len(n)), np.int64), row[order], tok[order], buckets)
                number += 1

    return run


_ROWS = "run long, kind int, a binary, b binary, c binary"
_ROW_TYPES = pa.schema([("run", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _count(table: pa.Table) -> pa.Table:
    """One bucket: to each run, those of its shingles that occur in two documents or more, with the number (65,535 at most)."""
    _text.give_back()  # of the group before
    run, kind, a, b = (table.column(c).to_pylist() for c in ("run", "kind", "a", "b"))
    if kind[0] < 2:
        return pa.table({"run": run, "kind": kind, "a": a, "b": b, "c": [None] * len(run)}, schema=_ROW_TYPES)
    toks = [_unpack(x) for x in a]
    weights = [np.ones(len(t), np.int64) if k == 2 else np.frombuffer(x, np.uint32).astype(np.int64) for t, k, x in zip(toks, kind, b)]
    size = np.array([len(t) for t in toks])
    every = np.concatenate(toks)
    order = np.argsort(every, kind="stable")
    s = every[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.add.reduceat(np.concatenate(weights)[order], at)
    number = np.empty(len(every), np.int64)
    number[order] = np.repeat(total, np.diff(np.append(at, len(s))))
    edge = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i in range(len(run)):
        own = number[edge[i] : edge[i + 1]]
        keep = own >= 2
        if keep.any():
            rest = np.frombuffer(b[i], np.uint16)[keep].tobytes() if kind[i] == 2 else b""
            out.append((run[i], kind[i], _pack(toks[i][keep]), rest, np.minimum(own[keep], 65535).astype(np.uint16).tobytes()))
    return pa.table(list(map(list, zip(*out))) if out else [[], [], [], [], []], schema=_ROW_TYPES)


def _ties(tok: np.ndarray, order: int) -> np.ndarray:
    return tok if not order else _text.mix(tok + _text.ODD[40 + order])


_DOC = "doc_id long, n long, sig long, sig2 long, shared int, prefix binary, others array<binary>, tokens binary"
_DOC_TYPES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("shared", pa.int32()), ("prefix", pa.binary()), ("others", pa.list_(pa.binary())), ("tokens", pa.binary())])


def _documents(num: int, den: int, ranks: bool):
    """One run: a row for each document; its shared tokens where it can have a partner. Without ranks: of equal sets the first only.
    With ranks: its prefixes too, and no row for the others."""

    def run(table: pa.Table) -> pa.Table:
        _text.give_back()  # of the run before
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b", "c"))))
        ids, rest = next((a, b) for k, a, b, _ in rows if k == 0)
        ids = np.frombuffer(ids, np.int64)
        n, sig, sig2 = np.frombuffer(rest, np.int64).reshape(3, -1)
        toks, docs, freq = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, a, b, c in rows:
            if k == 2:
                toks.append(_unpack(a))
                docs.append(np.frombuffer(b, np.uint16).astype(np.int64))
                freq.append(np.frombuffer(c, np.uint16).astype(np.int64))
        heavy = [(_unpack(a), np.frombuffer(c, np.uint16)) for k, a, _, c in rows if k == 3]
        for k, a, b, _ in rows:
            if k == 1:
                keys, number = np.concatenate([x for x, _ in heavy]), np.concatenate([x for _, x in heavy])
                order = np.argsort(keys)
                toks.append(own := _unpack(a))
                docs.append(np.frombuffer(b, np.uint16).astype(np.int64))
                freq.append(number[order][np.searchsorted(keys[order], own)].astype(np.int64))
        tok, doc, df = map(np.concatenate, (toks, docs, freq))
        shared = np.bincount(doc, minlength=len(ids))
        needs = _NEEDS(n, num, den)
        live = (n > 0) & (shared >= needs)
        seen: dict[tuple[int, int, int], int] = {}
        for i in np.lexsort((ids, ids == -(2**63))).tolist() if not ranks else ():  # null ids last: a class is named by another if it has one
            if live[i] and seen.setdefault((int(n[i]), int(sig[i]), int(sig2[i])), i) != i:
                live[i] = False
        keep = live[doc]
        tok, doc, df = tok[keep], doc[keep], df[keep]
        edge = np.concatenate([[0], np.cumsum(np.where(live, shared, 0))])
        width = n - needs + 1 - (n - shared)  # of the prefix, less the shingles that no other document has
        ranked = [np.lexsort((_ties(tok, o), df, doc)) for o in range(ORDERS if ranks else 0)]
        plain = np.lexsort((tok, doc))
        prefix, others, tokens = [None] * len(ids), [None] * len(ids), [None] * len(ids)
        for i in np.flatnonzero(live).tolist():
            s, w = edge[i], edge[i] + max(0, width[i])
            if ranks:
                prefix[i] = tok[ranked[0][s:w]].tobytes()
                others[i] = [np.sort(tok[r[s:w]].astype(np.uint32)).tobytes() for r in ranked[1:]]
            tokens[i] = _pack(tok[plain[s : edge[i + 1]]])
        null = ids == -(2**63)
        out = pa.table([pa.array(ids, mask=null), n, sig, sig2, shared.astype(np.int32), prefix, others, tokens], schema=_DOC_TYPES)
        return out.filter(pa.array(live)) if ranks else out

    return run


def _verify(num: int, den: int):
    def run(frames):
        for batch in frames:
            keep = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "others_a", "others_b", "tokens_a", "tokens_b")))
            for n, m, o, p, a, b in rows:
                ok = all(len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))) for x, y in zip(o, p))
                if ok:
                    same = len(np.intersect1d(_unpack(a), _unpack(b), assume_unique=True))
                    ok = den * same >= num * (n + m - same)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def links(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame, int]:
    """(classes, links, top): a row (doc_id, n_shingles, class_id) for each document, where class_id is the smallest doc_id of an equal set
    (null without words), and verified links (a, b) between class_ids that connect all that are similar. Sets that only documents
    without an id have get class_ids above top, the largest doc_id."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * own.rdd.getNumPartitions())
    counted = own.mapInArrow(_runs(buckets, k), _KEYED).groupBy("key").applyInArrow(_count, _ROWS)
    found = materialize(counted.groupBy("run").applyInArrow(_documents(num, den, False), _DOC))
    classes = materialize(found.where("n > 0").groupBy("n", "sig", "sig2").agg(F.min("doc_id").alias("class_id")))
    seen = found.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull() & (F.col("n") > 0))).first()
    top = -1 if seen[0] is None else max(-1, int(seen[0]))
    if seen[1]:
        room = 2**63 - 2 - top
        if room < 2**40:
            raise ValueError("doc_ids leave no numbers for documents without one")
        classes = materialize(classes.withColumn("class_id", F.coalesce("class_id", F.lit(top + 1) + F.pmod(F.xxhash64("n", "sig", "sig2"), F.lit(room)))))
    # once more among one document of each class: copies must not make a shingle look shared
    single = found.where("tokens IS NOT NULL").select("doc_id", "n", "sig", "sig2").join(classes, ["n", "sig", "sig2"]).where("doc_id = class_id").select("doc_id").distinct()
    single = found.where("tokens IS NOT NULL").select("doc_id", "n", "tokens").join(single, "doc_id")
    if seen[1]:
        nameless = found.where("doc_id IS NULL AND tokens IS NOT NULL").join(classes.where(F.col("class_id") > top), ["n", "sig", "sig2"])
        single = single.unionByName(nameless.groupBy("class_id", "n").agg(F.any_value("tokens").alias("tokens")).withColumnRenamed("class_id", "doc_id"))
    single = materialize(single)  # runs name rows by their place in a batch: it must be the same if a task runs again
    counted = single.mapInArrow(_reruns(buckets), _KEYED).groupBy("key").applyInArrow(_count, _ROWS)
    sets = materialize(counted.groupBy("run").applyInArrow(_documents(num, den, True), _DOC))
    discard(single)
    live = sets.select("doc_id", "n", "shared")

    def spread(frames):
        for batch in frames:
            data = batch.column("prefix").to_pylist()
            each = [len(x) // 8 for x in data]
            take = pa.array(np.repeat(np.arange(len(data)), each))
            flat = np.frombuffer(b"".join(data), np.int64)
            rank = pa.array(np.concatenate([*(np.arange(x) for x in each), np.zeros(0, np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(flat), *(batch.column(c).take(take) for c in ("doc_id", "n", "shared")), rank], ["tok", "node", "n", "shared", "rank"])

    postings = materialize(sets.select("doc_id", "n", "shared", "prefix").mapInArrow(spread, "tok long, node long, n long, shared int, rank int"))
    # sizes that allow the similarity; and a pair's first common shingle leaves each enough shared ones, itself included, for the overlap
    possible = lambda a, b: (den * F.least(a.n, b.n) >= num * F.greatest(a.n, b.n)) & ((den + num) * F.least(a.shared - a.rank, b.shared - b.rank) >= num * (a.n + b.n))

    def verified(pairs: DataFrame) -> DataFrame:
        # both sides rename every column: their exchanges are then the same, and the sets are shuffled once
        side = lambda key: sets.select(F.col("doc_id").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in ("n", "others", "tokens")))
        left, right = side("a"), side("b")
        return materialize(pairs.join(left, "a").join(right, "b").mapInArrow(_verify(num, den), "a long, b long"))

    # the first representative is the document with the fewest shingles of its own: most likely what the others are copies of
    first = lambda turn: F.struct((F.col("n") - F.col("shared")) / F.col("n"), F.xxhash64("component")) if not turn else F.struct(F.xxhash64("component", F.lit(turn)))
    label = live.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    parts: list[DataFrame] = []
    for turn in range(2):
        at = postings.join(label, "node")
        lead = at.groupBy("tok").agg(
            F.min(F.struct(first(turn).alias("h"), "component", "node", "n", "shared", "rank")).alias("r"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        ).where("lo <> hi").select("tok", "r.component", "r.node", "r.n", "r.shared", "r.rank")
        x, y = at.alias("x"), lead.alias("y")
        pairs = x.join(y, F.col("x.tok") == F.col("y.tok")).where(F.col("x.component") != F.col("y.component"))
        pairs = pairs.where(possible(_Of("x"), _Of("y"))).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("c"))
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        parts.append(verified(pairs))
        known = parts[0] if not turn else known.unionByName(parts[-1])
        found_now = components(known)
        before, label = label, materialize(live.select(F.col("doc_id").alias("node")).join(found_now, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        discard(found_now, *([before] if turn else []))
    # all the rest: pairs that share a prefix shingle and are not connected yet
    at = postings.join(label, "node")
    mixed = at.groupBy("tok").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("tok")
    at = materialize(at.join(mixed, "tok"))
    # the smaller of two shares at least 2 num / (den + num) of itself: few of its shingles can be the first common one
    small = at.where((den + num) * (F.col("shared") - F.col("rank")) >= 2 * num * F.col("n"))
    x, y = small.alias("x"), at.alias("y")
    smaller = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.component") != F.col("y.component")) & smaller & possible(_Of("x"), _Of("y")))
    parts.append(verified(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()))
    known = known.unionByName(parts[-1])
    out = materialize(found.select("doc_id", "n", "sig", "sig2").join(classes, ["n", "sig", "sig2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "class_id"))
    known = materialize(known)
    discard(at, postings, sets, label, found, classes, *parts)
    return out, known, top


class _Of:
    """Columns n, shared and rank of an aliased side."""

    def __init__(self, side: str):
        self.n, self.shared, self.rank = (F.col(f"{side}.{c}") for c in ("n", "shared", "rank"))


def similar(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest doc_id that links reach, itself included.

    Null and empty texts have no shingles and are linked with nothing; equal texts are linked. Null ids are linked like others, and
    get the smallest id of their group, or null if there is none. Rows with the same id count as one document that is similar to what
    either is similar to. Texts of any length are read whole. An empty table gives an empty result. Further columns are ignored,
    whatever their names.
    """
    classes, known, top = links(docs, k, num, den)
    comp = components(known)
    out = classes.join(comp.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    out = materialize(out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.coalesce("component", "class_id", "doc_id") <= top, F.coalesce("component", "class_id", "doc_id")).alias("component_id")))
    discard(classes, known, comp)
    return out
