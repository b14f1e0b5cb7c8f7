"""Repeated passages across documents, exact or with small changes, by chaining shared seeds.

1. Each document gives seeds: word k-mers that are least by hash in a window of them (minimizers), so that any common run of words of
   WINDOW + K - 1 or more has a common seed. Seeds are dealt by hash; each finds the document of smallest id that has it, and the
   document before its own that has it. So the links of a seed are at most twice its documents.
2. Back in their own batch, a document's matches with each of these earlier documents are chained: in order in both, each worth its words,
   less a cost for the gaps, by a Fenwick tree over the positions in the earlier one. Chains split at wide gaps.
3. The words around each chain are fetched, the chain's ends move outward while words agree, and the two passages are aligned; those
   long and alike enough are repeats. A chain that is not alike enough is split at its widest gap, and its parts are tried the same
   way. The earlier document keeps its passage.
4. The first document with a seed may lack the rest of a passage. So where all seeds of MIN_WORDS words are shared, the runs of
   MIN_WORDS words themselves are hashed and matched with the first document that has the whole run. What 3. did not find is aligned too.
5. What is then still open, where shared seeds in no passage found lie close over LEAST_SPAN words, is tried with all earlier documents
   that have two of these seeds at such a distance, first or not: pairs of seeds are dealt by hash, each brings its documents together,
   those that agree over MIN_WORDS words around it are chained and aligned as in 2. and 3.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from .ngram_join import TOKEN, _pack, _unpack
from ._util import discard, free_name, materialize as _materialize

K, WINDOW = 5, 8  # words of a seed; k-mers of a window
GAP_COST = 0.05  # for each word between chained seeds, on either side
MAX_GAP = 40  # words between chained seeds
LEAST_SPAN = 24  # of a chain: an exact passage of MIN_WORDS has at least so much between its outer seeds
MIN_WORDS, IDENTITY = 50, 0.8
MARGIN = 96  # words beyond a chain's ends that are looked at
HOT_IN_RUN = 16
MAX_DOC = 2**63 - 1


def materialize(df: DataFrame) -> DataFrame:
    """As in _util; the shuffles that led to the table go as soon as it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return _materialize(df)
    finally:
        spark.conf.set(name, before)


def _slide(v: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of w values."""
    n, width = len(v) - w + 1, 1
    if n <= 0:
        return v[:0]
    while width * 2 <= w:
        v = op(v[: len(v) - width], v[width:])
        width *= 2
    return op(v[:n], v[w - width : w - width + n])


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, however long: _text.grams tells 48 places apart."""
    if k <= 48 or len(words) < k:
        return _text.grams(words, k)
    rest = _grams(words[48:], k - 48)
    return _text.mix(_text.grams(words, 48)[: len(rest)] * _text.ODD[2] + rest)


def seeds(words: np.ndarray, owner: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position in words, 48-bit hash) of each seed of concatenated texts; windows lie within one text."""
    g = _grams(words, k)
    if len(g) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _slide(g, window, np.minimum)
    inside = owner[: len(low)] == owner[window + k - 2 : window + k - 2 + len(low)]
    low = np.where(inside, low, 0)
    pad = np.zeros(window - 1, np.uint64)
    picked = _slide(np.concatenate([pad, low, pad]), window, np.maximum) == g
    # of a run of the same words: both ends, and one for each window
    new = np.concatenate([[True], g[1:] != g[:-1]])
    place = np.arange(len(g))
    picked &= new | np.append(new[1:], True) | ((place - np.maximum.accumulate(np.where(new, place, 0))) % window == 0)
    at = np.flatnonzero(picked)
    return at, g[at] & TOKEN


def _ints(values: np.ndarray) -> bytes:
    """Planes of the bytes of unsigned 64-bit numbers; those of zeros compress away."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_ints(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def _runs(buckets: int, k: int, window: int):
    def run(frames):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        for whole in frames:
            for batch in _text.batches([whole]):
                name = (part << 24) + number
                number += 1
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                buf, offs = _text.raw(batch.column("text"))
                low = _text.LOWER[buf]
                starts, ends, first = _text.split(low, offs)
                owner = np.repeat(np.arange(len(ids)), np.diff(first))
                at, tok = seeds(_text.word_hashes(low, starts, ends), owner, k, window)
                if "windows" in batch.schema.names:  # only seeds that begin in them
                    mark = np.zeros(len(starts) + 1, np.int64)
                    for i, windows in enumerate(batch.column("windows").to_pylist()):
                        for w in windows:
                            mark[min(first[i] + w["s"], first[i + 1])] += 1
                            mark[min(first[i] + w["e"], first[i + 1])] -= 1
                    inside = np.cumsum(mark)[at] > 0
                    at, tok = at[inside], tok[inside]
                doc = owner[at]
                pos = at - first[doc]
                order = np.lexsort((pos, ids[doc], tok))
                tok, doc, pos = tok[order], doc[order], pos[order]
                base = int(ids.min()) if len(ids) else 0
                shift = ids.astype(np.uint64) - np.uint64(base % 2**64)  # wraps around
                out = [(-1 - name, name, 0, base, ids.tobytes(), None, None, None)]
                head = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
                count = np.diff(np.append(head, len(tok)))
                hot = count >= HOT_IN_RUN
                mine = np.repeat(hot, count)
                # of a seed that is frequent in the run, the bucket learns all places in the run's first document that has it
                lead = mine & (ids[doc] == np.repeat(ids[doc[head]], count))
                if hot.any():
                    out.append((-1 - name, name, 1, base, _pack(tok[mine]), None, doc[mine].astype(np.uint16).tobytes(), _ints(pos[mine])))
                bounds = (np.arange(1, buckets, dtype=np.float64) * (2.0**48 / buckets)).astype(np.uint64)
                for kind, t, d, p in ((2, tok[~mine], doc[~mine], pos[~mine]), (3, tok[lead], doc[lead], pos[lead])):
                    cut = np.concatenate([[0], np.searchsorted(t, bounds), [len(t)]])
                    for b in np.flatnonzero(np.diff(cut)).tolist():
                        s = slice(cut[b], cut[b + 1])
                        out.append((b, name, kind, base, _pack(t[s]), _ints(shift[d[s]]), d[s].astype(np.uint16).tobytes(), _ints(p[s])))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["key", "run", "kind", "base", "tok", "id", "doc", "pos"])

    return run


_KEYED = "key long, run long, kind int, base long, tok binary, id binary, doc binary, pos binary"
_FOUND = "run long, kind int, tok binary, doc binary, pos binary, ref binary, ref_pos binary, near binary, near_pos binary"
_FOUND_TYPES = pa.schema([("run", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("tok", "doc", "pos", "ref", "ref_pos", "near", "near_pos"))])


def _names(values: np.ndarray) -> bytes:
    """Document ids, as planes of their distance from the least."""
    base = values.min() if len(values) else np.int64(0)
    return np.int64(base).tobytes() + _ints(values.astype(np.uint64) - np.uint64(int(base) % 2**64))


def _from_names(data: bytes) -> np.ndarray:
    return (_from_ints(data[8:]).view(np.uint64) + np.frombuffer(data[:8], np.uint64)).view(np.int64)


class _Holders:
    """Occurrences sorted by (seed, document, place): the documents that hold each seed, and their places."""

    def __init__(self, tok: np.ndarray, who: np.ndarray, where: np.ndarray):
        n = len(tok)
        self.who, self.where = who, where
        new_tok = np.concatenate([[True], tok[1:] != tok[:-1]])[:n]
        new = new_tok | np.concatenate([[True], who[1:] != who[:-1]])[:n]
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, n))
        self.of = np.cumsum(new) - 1  # number of the holder that an occurrence belongs to
        self.rank = np.arange(n) - self.begin[self.of]
        self.first = np.maximum.accumulate(np.where(new_tok[self.begin], np.arange(len(self.begin)), 0)) if n else self.begin  # of holders

    def place(self, holder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence the place in a holder: a seed's n-th occurrence meets the holder's n-th one, over and over if it has fewer.
        So where both repeat themselves, runs meet runs."""
        at = self.begin[holder] + self.rank % self.size[holder]
        return self.who[at], self.where[at]


def _first(table: pa.Table) -> pa.Table:
    """One bucket: for each occurrence of a seed that two documents have, the seed, the place in the one of smallest id, and in the one
    before its own."""
    return _earlier(table, True)


def _first_alone(table: pa.Table) -> pa.Table:
    """One bucket: for each occurrence of a run of words that two documents have, the place in the one of smallest id."""
    return _earlier(table, False)


def _earlier(table: pa.Table, all_of_it: bool) -> pa.Table:
    _text.give_back()  # of the group before
    run, kind, base, tok, ids, doc, pos = (table.column(c).to_pylist() for c in ("run", "kind", "base", "tok", "id", "doc", "pos"))
    if kind[0] < 2:
        return pa.table([run, kind, tok, doc, pos, *[[None] * len(run)] * 4], schema=_FOUND_TYPES)
    toks = [_unpack(x) for x in tok]
    own = [_from_ints(i) + b for i, b in zip(ids, base)]
    places = [_from_ints(p) for p in pos]
    every, who, where = np.concatenate(toks), np.concatenate(own), np.concatenate(places)
    order = np.lexsort((where, who, every))
    h = _Holders(every[order], who[order], where[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    ref, ref_pos = h.place(h.first[h.of])
    near, near_pos = h.place(np.maximum(h.of - 1, h.first[h.of]))
    last = np.append(np.flatnonzero(np.diff(h.first)), len(h.begin) - 1)  # a seed's last holder
    many = np.repeat(h.first[last] != last, np.diff(np.append(-1, last)))
    edge = np.concatenate([[0], np.cumsum([len(t) for t in toks])])
    out = []
    for i in range(len(run)):
        at = back[edge[i] : edge[i + 1]]
        if kind[i] == 3:
            holder = h.first[h.of[at[np.concatenate([[True], toks[i][1:] != toks[i][:-1]])]]]
            size = h.size[holder]
            j = np.repeat(h.begin[holder] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append((run[i], 3, _pack(every[order][j]), None, None, _names(h.who[j]), _ints(h.where[j]), None, None))
        elif (keep := many[h.of[at]]).any():
            at = at[keep]
            more = (_pack(toks[i][keep]), _names(near[at]), _ints(near_pos[at])) if all_of_it else (None,) * 3
            out.append((run[i], 2, more[0], np.frombuffer(doc[i], np.uint16)[keep].tobytes(), _ints(places[i][keep]), _names(ref[at]), _ints(ref_pos[at]), *more[1:]))
    return pa.table(list(map(list, zip(*out))) if out else [[] for _ in range(9)], schema=_FOUND_TYPES)


def chain(x: list[int], y: list[int], k: int = K, cost: float = GAP_COST) -> list[list[int]]:
    """Chains of matches (x, y), given by rising x: index lists in order, each match in one chain at most, best chains first.

    A match adds k to a chain that it follows in both x and y, less cost for each word that it lies further on, in x and in y.
    """
    n = len(x)
    if n > 1:  # one after the other in both, and no gap costs more than was won before it: all are one chain
        ax, ay = np.diff(np.array(x)), np.diff(np.array(y))
        if ax.min() > 0 and ay.min() > 0:
            paid = cost * (ax + ay)
            if (k + np.concatenate([[0.0], np.cumsum(k - paid)[:-1]]) - paid > 0).all():
                return [list(range(n))]
    levels = sorted(set(y))
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(levels) + 1)  # Fenwick tree of prefix maxima
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:  # matches of one place don't follow each other
            r, best = bisect_left(levels, y[j]), (-1e18, -1)
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            gain = best[0] - cost * (x[j] + y[j])
            score[j], before[j] = (k + gain, best[1]) if gain > 0 else (float(k), -1)
            j += 1
        for t in range(i, j):
            r, value = bisect_left(levels, y[t]) + 1, (score[t] + cost * (x[t] + y[t]), t)
            while r <= len(levels):
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
        i = j
    used, out = [False] * n, []
    for t in sorted(range(n), key=lambda t: (-score[t], t)):
        path = []
        while t >= 0 and not used[t]:
            used[t] = True
            path.append(t)
            t = before[t]
        if path:
            out.append(path[::-1])
    return out


#: Of a seed that a document shares, and of a run's shared seeds: the run, and what s and toks hold (see _chains).
_ALL = "doc_id long, s int, e int, ref long, rs int, re int, seeds binary, turn int, run long, toks binary, docs binary"
_CHAIN = "doc_id long, s int, e int, ref long, rs int, re int, seeds binary, turn int"
_CHAIN_TYPES = pa.schema([("doc_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("ref", pa.int64()), ("rs", pa.int32()), ("re", pa.int32()), ("seeds", pa.binary()), ("turn", pa.int32())])


_ALL_TYPES = pa.schema([*_CHAIN_TYPES, ("run", pa.int64()), ("toks", pa.binary()), ("docs", pa.binary())])
REGION, STRETCH, SHARED = 10, 11, 12
FURTHER = 3  # turn of what holders other than the first and the one before have


def _places(x: list[int], y: list[int]) -> bytes:
    """The seeds of a chain: where they lie in the document, then where in the earlier one."""
    return np.array([*x, *y], np.int32).tobytes()


def _matches(table: pa.Table) -> tuple[np.ndarray, ...]:
    """One run: ids of its documents; then of each shared seed the document's number, its place, the first document that has it, the
    place there, the document before its own that has it (the first again where no other is known), the place there, and the seed.
    What _first_alone leaves out is that of the first document, and 0."""
    _text.give_back()  # of the run before
    rows = table.to_pylist()
    ids = np.frombuffer(next(r["tok"] for r in rows if r["kind"] == 0), np.int64)
    parts = [(*(np.zeros(0, np.int64) for _ in range(6)), np.zeros(0, np.uint64))]
    for r in rows:
        if r["kind"] == 2:
            ref, ref_pos = _from_names(r["ref"]), _from_ints(r["ref_pos"])
            more = (ref, ref_pos, np.zeros(len(ref), np.uint64)) if r["near"] is None else (_from_names(r["near"]), _from_ints(r["near_pos"]), _unpack(r["tok"]))
            parts.append((np.frombuffer(r["doc"], np.uint16).astype(np.int64), _from_ints(r["pos"]), ref, ref_pos, *more))
    heavy = [(_unpack(r["tok"]), _from_names(r["ref"]), _from_ints(r["ref_pos"])) for r in rows if r["kind"] == 3]
    for r in rows:
        if r["kind"] == 1:
            keys, ref, ref_pos = map(np.concatenate, zip(*heavy))
            order = np.argsort(keys, kind="stable")
            keys, ref, ref_pos = keys[order], ref[order], ref_pos[order]
            tok, doc, pos = _unpack(r["tok"]), np.frombuffer(r["doc"], np.uint16).astype(np.int64), _from_ints(r["pos"])
            h = _Holders(tok, ids[doc], pos)
            lo, hi = np.searchsorted(keys, tok, "left"), np.searchsorted(keys, tok, "right")
            at = lo + h.rank % (hi - lo)
            near, near_pos = h.place(np.maximum(h.of - 1, h.first[h.of]))
            alone = h.of == h.first[h.of]
            parts.append((doc, pos, ref[at], ref_pos[at], np.where(alone, ref[at], near), np.where(alone, ref_pos[at], near_pos), tok))
    return ids, *map(np.concatenate, zip(*parts))


def _shared_runs(doc: np.ndarray, x: np.ndarray, k: int, window: int, min_words: int) -> list[tuple[int, int, int]]:
    """(document's number, s, e): where runs of min_words words can begin that have shared seeds only, s included, e not."""
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (x[1:] - x[:-1] > window)])) if len(doc) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(doc)) - 1 if len(doc) else head
    # in such a run the first seed begins at its window-th word at the latest, the last at most window - 1 before its last k words
    s, e = np.maximum(0, x[head] - (window - 1)), x[last] - (min_words - k - (window - 1)) + 1
    keep = e > s
    return list(zip(doc[head][keep].tolist(), s[keep].tolist(), e[keep].tolist()))


def _exact(min_words: int):
    """One run: the runs of words that a document shares with the first document that has all min_words words from each place."""

    def run(table: pa.Table) -> pa.Table:
        ids, doc, x, ref, y, *_ = _matches(table)
        keep = ref < ids[doc]
        doc, x, ref, y = doc[keep], x[keep], ref[keep], y[keep]
        out = []
        if len(doc):
            order = np.lexsort((x, y - x, ref, doc))
            doc, x, ref, y = doc[order], x[order], ref[order], y[order]
            same = (doc[1:] == doc[:-1]) & (ref[1:] == ref[:-1]) & (x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1)
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            last = np.append(head[1:], len(doc)) - 1
            for i, j in zip(head.tolist(), last.tolist()):
                out.append((int(ids[doc[i]]), int(x[i]), int(x[j]) + min_words, int(ref[i]), int(y[i]), int(y[j]) + min_words, _places([int(x[i]), int(x[j])], [int(y[i]), int(y[j])]), 2))
        return pa.table(list(map(list, zip(*out))) if out else [[] for _ in range(8)], schema=_CHAIN_TYPES)

    return run


def _close(doc: np.ndarray, x: np.ndarray, which: np.ndarray, k: int, least: int) -> list[np.ndarray]:
    """Of the seeds in which: those of a document that follow each other without a wide gap over least words or more, by place."""
    which = which[np.lexsort((x[which], doc[which]))]
    if not len(which):
        return []
    d, a = doc[which], x[which]
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] - a[:-1] > MAX_GAP + k)]))
    last = np.append(head[1:], len(which)) - 1
    return [which[i : j + 1] for i, j in zip(head.tolist(), last.tolist()) if a[j] + k - a[i] >= least]


def _surely(x: np.ndarray, y: np.ndarray, k: int, min_words: int, identity: float) -> bool:
    """Whether the words of a chain's seeds alone make it long and alike enough."""
    held = lambda v: int(np.minimum(np.diff(v), k).sum()) + k
    span = max(x[-1] - x[0], y[-1] - y[0]) + k
    return span >= min_words and min(held(x), held(y)) >= min(1.0, identity + 0.05) * span


def _chains(k: int, window: int, least: int, min_words: int, identity: float):
    """One run: the chains of its documents, with the first holders of seeds and with the holders before. What a chain with a first
    holder surely has is not tried with the holder before. By turn, further rows:

    REGION: where runs of min_words words may be shared as a whole. STRETCH: a document's seeds that earlier ones have, as long as they
    lie so close that they can be one chain. SHARED: all shared seeds of the run, with the numbers of their documents and these' ids.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, doc, x, ref, y, near, z, tok = _matches(table)
        name = table.column("run")[0].as_py()
        out = [(int(ids[d]), s, e, None, None, None, None, REGION) for d, s, e in _shared_runs(doc, x, k, window, min_words)]
        late = np.flatnonzero(ref < ids[doc])
        out += [(int(ids[doc[o[0]]]), int(x[o[0]]), int(x[o[-1]]) + k, None, None, None, x[o].astype(np.int32).tobytes(), STRETCH, name) for o in _close(doc, x, late, k, least)]
        order = np.lexsort((x, doc))
        out.append((None, None, None, None, None, None, _ints(x[order]), SHARED, name, _pack(tok[order]), doc[order].astype(np.uint16).tobytes() + ids.tobytes()))
        sure: dict[int, list[tuple[int, int]]] = {}
        for turn, (other, there, keep) in enumerate(((ref, y, ref < ids[doc]), (near, z, (near != ref) & (near < ids[doc])))):
            d, a, o, b = doc[keep], x[keep], other[keep], there[keep]
            order = np.lexsort((b, a, o, d))
            d, a, o, b = d[order], a[order], o[order], b[order]
            head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])])) if len(d) else np.zeros(0, np.int64)
            tail = np.append(head[1:], len(d)) if len(d) else head
            long = a[tail - 1] - a[head] + k >= least if len(d) else head
            for s, e in zip(head[long].tolist(), tail[long].tolist()) if len(d) else ():
                if turn and any(lo <= a[s] and a[e - 1] + k <= hi for lo, hi in sure.get(int(d[s]), ())):
                    continue
                xs, ys = a[s:e].tolist(), b[s:e].tolist()
                for path in chain(xs, ys, k):
                    px, py = a[s:e][path], b[s:e][path]
                    wide = np.flatnonzero((np.diff(px) > MAX_GAP + k) | (np.diff(py) > MAX_GAP + k)) + 1  # split at wide gaps
                    for i, j in zip([0, *wide.tolist()], [*wide.tolist(), len(px)]):
                        qx, qy = px[i:j], py[i:j]
                        lo, hi = int(qx[0]), int(qx[-1]) + k
                        if hi - lo < least or turn and any(p <= lo and hi <= q for p, q in sure.get(int(d[s]), ())):
                            continue
                        if not turn and _surely(qx, qy, k, min_words, identity):
                            sure.setdefault(int(d[s]), []).append((lo, hi))
                        out.append((int(ids[d[s]]), lo, hi, int(o[s]), int(qy[0]), int(qy[-1]) + k, np.concatenate([qx, qy]).astype(np.int32).tobytes(), turn))
        return pa.table(list(map(list, zip(*(r + (None,) * (11 - len(r)) for r in out)))), schema=_ALL_TYPES)

    return run


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _extend(same: np.ndarray, drop: int = 6) -> int:
    """How far words agree: agreement is worth 1, a difference costs 2; stops where the sum falls drop below its best."""
    if not len(same):
        return 0
    if same.all():
        return len(same)
    value = np.cumsum(np.where(same, 1, -2))
    best = np.maximum.accumulate(value)
    bad = np.flatnonzero(np.maximum(best, 0) - value >= drop)
    stop = int(bad[0]) if len(bad) else len(value)
    if not stop or value[:stop].max() <= 0:
        return 0
    return int(np.argmax(value[:stop])) + 1


def _same(a: np.ndarray, s: int, e: int, b: np.ndarray, rs: int, re: int, x: list[int], y: list[int], k: int) -> int:
    """Words of a[s:e] and b[rs:re] that align, through the seeds (k words at x in a and at y in b) and the best way between them."""
    if e - s == re - rs and (straight := int((a[s:e] == b[rs:re]).sum())) >= 0.95 * (e - s):
        return straight
    at, there, same = s, rs, 0
    for i, j in [*zip(x, y), (e, re)]:
        late = max(at - i, there - j, 0)  # words of this seed that the one before has taken
        if i < e and late >= k:
            continue
        i, j = i + late, j + late
        if i > at and j > there:
            same += common(a[at:i].tolist(), b[there:j].tolist())
        same += k - late if i < e else 0
        at, there = i + k - late, j + k - late
    return same


def align(a: np.ndarray, x: list[int], b: np.ndarray, y: list[int], k: int, drop: int = 6, min_words: int = 0, identity: float = 0.0) -> tuple[int, int, int, int, int]:
    """The passage of seeds at x in words a and at y in b, its ends moved outward: where it lies in both, and how many words align (0 if
    it is shorter than min_words or has not enough words in common to be alike)."""
    s, e, rs, re = x[0], x[-1] + k, y[0], y[-1] + k
    n = min(s, rs)
    left = _extend((a[s - n : s] == b[rs - n : rs])[::-1], drop)
    n = min(len(a) - e, len(b) - re)
    right = _extend(a[e : e + n] == b[re : re + n], drop)
    s, e, rs, re = s - left, e + right, rs - left, re + right
    least = identity * max(e - s, re - rs)
    if e - s < min_words or min(e - s, re - rs) < least or identity and len(x) < (e - s) // (3 * k) and np.isin(a[s:e], b[rs:re]).sum() < least:
        return s, e, rs, re, 0
    return s, e, rs, re, _same(a, s, e, b, rs, re, x, y, k)


def parts(a: np.ndarray, x: list[int], b: np.ndarray, y: list[int], k: int, min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages of a chain of seeds at x in words a and at y in b: the whole, or what is left of it by splits at the widest gap.

    Ends move over differences first; where that costs the likeness, over equal words alone. So a run of min_words equal words that
    the chain has seeds of is in a passage.
    """
    out, todo = [], [(0, len(x))]
    while todo:
        i, j = todo.pop()
        for drop in (6, 1):
            s, e, rs, re, same = found = align(a, x[i:j], b, y[i:j], k, drop, min_words, identity)
            if e - s >= min_words and same >= identity * max(e - s, re - rs):
                out.append(found)
                break
        else:
            if j - i > 1:
                at = max(range(i + 1, j), key=lambda t: max(x[t] - x[t - 1], y[t] - y[t - 1]))
                todo += [(at, j), (i, at)]
    return sorted(set(out))


_ROOM = 4 << 20  # bytes of words that leave Python together


def _fetch(names: list[str], types: tuple, column: str, begin: str, end: str, hashes: type = np.uint32):
    """(doc_id, text, column of structs) to a row for each struct: its fields, the word that its words begin at, and their hashes."""

    def run(frames):
        for batch in _text.batches(frames):
            buf, offs = _text.raw(batch.column("text"))
            low = _text.LOWER[buf]
            starts, ends, first = _text.split(low, offs)
            words = _text.word_hashes(low, starts, ends).astype(hashes)
            out, held = [], 0
            for i, (doc, wanted) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column(column).to_pylist())):
                own = words[first[i] : first[i + 1]]
                for w in wanted:
                    at = max(0, w[begin] - MARGIN)
                    piece = own[at : w[end] + MARGIN].tobytes()
                    out.append((doc, *w.values(), at, piece))
                    held += len(piece)
                    if held > _ROOM:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    return run


def _aligned(k: int, min_words: int, identity: float):
    def run(frames):
        for batch in _text.batches(frames):
            out = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["words"], np.uint32), np.frombuffer(r["ref_words"], np.uint32)
                o, p = r["begin"], r["ref_begin"]
                x, y = np.frombuffer(r["seeds"], np.int32).reshape(2, -1)
                for s, e, rs, re, same in parts(a, (x - o).tolist(), b, (y - p).tolist(), k, min_words, identity):
                    out.append((r["doc_id"], s + o, e - s, r["ref"], rs + p, re - rs, same, same / max(e - s, re - rs), r["turn"]))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            cols = list(zip(*out)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [c.split()[0] for c in _HIT.split(", ")])

    return run


SCHEMA = "doc_id long, start_word int, n_words int, ref_doc_id long, ref_start_word int, ref_n_words int, matched_words int, identity double"
_HIT = SCHEMA + ", turn int"


def numbered(docs: DataFrame) -> tuple[DataFrame, str, int | None]:
    """docs with a column that tells rows apart, its name, and the largest doc_id if rows share one.

    The column is the doc_id (null where that or the text is null). Of rows that share a doc_id one keeps it, the others get numbers
    above all ids: they count as later documents.
    """
    key = free_name(docs, "_row_key")
    usable = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    ids = F.when(usable, F.col("doc_id").cast("long"))
    shared = docs.where(usable).groupBy(F.col("doc_id").cast("long").alias("id")).count().where("count > 1").limit(1).count()
    if not shared:
        return docs.withColumn(key, ids), key, None
    row, first = free_name(docs, "_row"), free_name(docs, "_row_first")
    all_rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    top = all_rows.agg(F.max(ids)).first()[0]
    if top >= 2**62 or all_rows.agg(F.max(row)).first()[0] >= 2**62:
        raise ValueError("doc_ids leave no numbers for rows that share one")
    lead = all_rows.where(usable).groupBy(ids.alias("id")).agg(F.min(row).alias(first)).select(first)
    out = all_rows.join(lead, all_rows[row] == lead[first], "left")
    return out.select(*docs.columns, F.when(F.col(first).isNotNull(), ids).when(usable, F.col(row) + (max(top, 0) + 1)).alias(key)), key, top


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, k: int = K, window: int = WINDOW) -> DataFrame:
    """Passages of a document that an earlier one (of smaller doc_id) has too: where they lie in both, in words, and how many align.

    Words are runs of anything but ASCII white space, A-Z in lower case. A document's passages may overlap where they match several
    earlier documents. Copies give one passage each, of their whole text. Null ids and null texts take no part, empty texts have no
    passages. Of rows with one id, one keeps its place and the others count as documents after all others. An empty table gives an
    empty result. Texts of any length are read whole. Further columns are ignored, whatever their names.
    """
    rows, key, top = numbered(docs.select("doc_id", "text"))
    found = _repeats(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")), min_words, identity, k, window)
    if top is None:
        return found
    names = rows.where(F.col(key) > top).select(F.col(key).alias("_key"), F.col("doc_id").cast("long").alias("_own"))
    for c in ("doc_id", "ref_doc_id"):
        found = found.join(names, found[c] == names["_key"], "left").withColumn(c, F.coalesce("_own", c)).drop("_key", "_own")
    return found


def _repeats(own: DataFrame, min_words: int, identity: float, k: int, window: int) -> DataFrame:
    """repeats() of rows (doc_id, text) without nulls, each with an id of its own."""
    spark = own.sparkSession
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * own.rdd.getNumPartitions())
    least = max(k, min(LEAST_SPAN, min_words - 2 * (window - 1)))
    met = own.mapInArrow(_runs(buckets, k, window), _KEYED).groupBy("key").applyInArrow(_first, _FOUND)
    all_chains = materialize(met.groupBy("run").applyInArrow(_chains(k, window, least, min_words, identity), _ALL))
    chains, regions = all_chains.where("ref IS NOT NULL").select(*_CHAIN_TYPES.names), all_chains.where(f"turn = {REGION}").select("doc_id", "s", "e")
    hits = _align_all(own, chains, k, min_words, identity)
    # a passage of the holder before that lies within one of a first holder says nothing new
    found = materialize(_outside(hits.where("turn = 1"), hits.where("turn = 0"), "start_word", "n_words").unionByName(hits.where("turn = 0")).drop("turn"))
    # whole runs of min_words words, where every seed is shared
    runs = _with_text(own, regions.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("windows")), "windows")
    keyed = materialize(runs.mapInArrow(_runs(buckets, min_words, 1), _KEYED))
    exact = keyed.groupBy("key").applyInArrow(_first_alone, _FOUND).groupBy("run").applyInArrow(_exact(min_words), _CHAIN)
    have = found.select("doc_id", F.col("start_word").alias("s"), (F.col("start_word") + F.col("n_words")).alias("e"))
    rest = materialize(_outside(exact, have, "s"))
    more = _align_all(own, rest, min_words, min_words, identity).drop("turn")
    # what is still open is tried with all other documents that may have it
    further, used = _further(own, all_chains, found.unionByName(more), buckets, least, min_words, identity, k)
    out = materialize(found.unionByName(more).unionByName(further).distinct())
    discard(all_chains, keyed, rest, hits, found, more, *used)
    return out


def _with_text(own: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """Texts of the documents that are asked for; merged at every size, as what is asked grows with the documents."""
    return own.join(asked.hint("shuffle_merge"), "doc_id").select("doc_id", "text", column)


#: What all other holders of open seeds are told by: pairs of seeds, so many words apart in the document, and in the other one.
APART, APART_THERE = (LEAST_SPAN - K, 90), (12, 112)
_SLOTS = 4096  # that words between two seeds are told apart by
BLOCK = 1024  # documents of a pair of seeds that meet in one place; more meet in blocks
AT_ONCE = 1 << 14  # seeds whose pairs are told at once
TILE = 1 << 12  # places of pairs of seeds whose words are laid out at once
PIECE = 1 << 16  # rows that leave Python together
_OPEN = "run long, turn int, doc_id long, seeds binary, toks binary, docs binary"
_SEEDS = "key long, run long, toks binary, ids binary, pos binary, open binary"
_TWOS = "key long, twos binary, ids binary, xi binary, xj binary, open binary"
_ASKED = "doc_id long, grp long, two long, role int, xi int, xj int"
_PAIR = "doc_id long, ref long, xi int, xj int, yi int, yj int"
_DDL = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _DDL[c.split()[1]]) for c in ddl.split(", ")])


def _open(k: int, least: int):
    """(doc_id, run, seeds, found) to the seeds that are in no passage found, where they can be one chain."""

    def run(frames):
        for batch in frames:
            out = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["seeds"], np.int32).astype(np.int64)
                if r["found"]:
                    s, e = np.array(sorted((p["s"], p["e"]) for p in r["found"])).T
                    at = np.searchsorted(s, x, "right") - 1
                    x = x[(at < 0) | (np.maximum.accumulate(e)[at] < x + k)]
                out += [(r["run"], STRETCH, r["doc_id"], x[o].astype(np.int32).tobytes(), None, None) for o in _close(np.zeros(len(x)), x, np.arange(len(x)), k, least)]
            yield pa.RecordBatch.from_pylist([dict(zip(_arrow(_OPEN).names, r)) for r in out], _arrow(_OPEN))

    return run


def _by_bucket(buckets: int, values: np.ndarray, row) -> list[tuple]:
    """row(bucket, slice) for each bucket of 48-bit numbers, which are sorted, that has any."""
    cut = np.concatenate([[0], np.searchsorted(values, (np.arange(1, buckets, dtype=np.float64) * (2.0**48 / buckets)).astype(np.uint64)), [len(values)]])
    return [row(b, slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut)).tolist()]


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    return pa.table(list(map(list, zip(*rows))) if rows else [[] for _ in ddl.split(", ")], schema=_arrow(ddl))


def _marked(buckets: int):
    """One run: its shared seeds for each bucket, and which of them are open."""

    def run(table: pa.Table) -> pa.Table:
        _text.give_back()
        rows = table.to_pylist()
        (r,) = (r for r in rows if r["turn"] == SHARED)
        name, tok, pos = r["run"], _unpack(r["toks"]), _from_ints(r["seeds"])
        doc, ids = np.frombuffer(r["docs"][: 2 * len(tok)], np.uint16).astype(np.int64), np.frombuffer(r["docs"][2 * len(tok) :], np.int64)
        number = {d: i for i, d in enumerate(ids.tolist())}
        wanted = [number[r["doc_id"]] << 32 | np.frombuffer(r["seeds"], np.int32).astype(np.int64) for r in rows if r["turn"] == STRETCH]
        is_open = np.isin(doc << 32 | pos, np.concatenate(wanted)) if wanted else np.zeros(len(tok), bool)
        order = np.lexsort((pos, ids[doc], tok))
        tok, who, pos, is_open = tok[order], ids[doc[order]], pos[order], is_open[order]
        return _table(_by_bucket(buckets, tok, lambda b, s: (b, name, _pack(tok[s]), _names(who[s]), _ints(pos[s]), np.packbits(is_open[s]).tobytes())), _SEEDS)

    return run


def _joined(table: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of seeds or pairs of them as arrays; the last are bits."""
    _text.give_back()
    read = [_unpack, _from_names, *[_from_ints] * (len(names) - 3)]
    parts = [[f(v) for f, v in zip(read, row)] + [np.unpackbits(np.frombuffer(row[-1], np.uint8))] for row in zip(*(table.column(c).to_pylist() for c in names))]
    return [np.concatenate(c) for c in zip(*([*p[:-1], p[-1][: len(p[0])].astype(bool)] for p in parts))]


def _wanted(table: pa.Table) -> pa.Table:
    """One bucket: all occurrences of the seeds that are open anywhere."""
    tok, who, pos, is_open = _joined(table, ("toks", "ids", "pos", "open"))
    keep = np.isin(tok, np.unique(tok[is_open]))
    run = np.repeat(table.column("run").to_numpy(), [len(t) // 6 for t in table.column("toks").to_pylist()])
    order = np.flatnonzero(keep)
    order = order[np.argsort(run[order], kind="stable")]
    head = np.flatnonzero(np.concatenate([[True], np.diff(run[order]) != 0])) if len(order) else order
    return _table([(0, int(run[o[0]]), _pack(tok[o]), _names(who[o]), _ints(pos[o]), np.packbits(is_open[o]).tobytes()) for o in np.split(order, head[1:]) if len(o)], _SEEDS)


def _in_pieces(f: Callable[[pa.Table], Iterator[pa.Table]]):
    """f, from a group to tables, as Spark takes it: each table goes on its way before the next is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(pa.Table.from_batches(batches)):
            yield from out.to_batches()

    return run


def _twos(buckets: int, at_once: int = AT_ONCE):
    """One run: pairs of the seeds of a document, so many words apart; open ones are of two open seeds."""

    def run(table: pa.Table) -> Iterator[pa.Table]:
        tok, who, pos, is_open = _joined(table, ("toks", "ids", "pos", "open"))
        order = np.lexsort((pos, who))
        tok, who, pos, is_open = tok[order], who[order], pos[order], is_open[order]
        for s in range(0, len(tok), at_once):
            left, right = [], []
            for step in range(1, len(tok) - s):
                e = min(s + at_once, len(tok) - step)
                apart = pos[s + step : e + step] - pos[s:e]
                near = (who[s + step : e + step] == who[s:e]) & (apart <= APART_THERE[1])
                if not near.any():
                    break
                at = s + np.flatnonzero(near & (apart >= APART_THERE[0]))
                left.append(at)
                right.append(at + step)
            if not left:
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            two = _text.mix(tok[i] * _text.ODD[3] + tok[j] * _text.ODD[4]) & TOKEN
            both = is_open[i] & is_open[j] & (pos[j] - pos[i] >= APART[0]) & (pos[j] - pos[i] <= APART[1])
            order = np.lexsort((pos[i], who[i], two))
            i, j, two, both = i[order], j[order], two[order], both[order]
            yield _table(_by_bucket(buckets, two, lambda b, s: (b, _pack(two[s]), _names(who[i[s]]), _ints(pos[i[s]]), _ints(pos[j[s]]), np.packbits(both[s]).tobytes())), _TWOS)

    return run


def _met(buckets: int, block: int = BLOCK, piece: int = PIECE):
    """One bucket: pairs of seeds that are open in a document and that an earlier one has, with all that have them. Role 1: it looks for
    earlier ones; 2: it may be one; 3: both. Many documents meet in blocks of them, each with each before it and with itself.

    Of a document that has a pair at more places than any that looks, the places that none of these meets stay away.
    """

    def run(table: pa.Table) -> Iterator[pa.Table]:
        two, who, xi, xj, is_open = _joined(table, ("twos", "ids", "xi", "xj", "open"))
        sought = np.flatnonzero(np.isin(two, np.unique(two[is_open])))
        order = sought[np.lexsort((xi[sought], who[sought], two[sought]))]
        two, who, xi, xj, is_open = two[order], who[order], xi[order], xj[order], is_open[order]
        h = _Holders(two, who, xi)
        late = is_open & (h.of > h.first[h.of])
        group = h.first[h.of]  # a number for each pair of seeds
        last, most = np.zeros(len(h.begin), np.int64), np.zeros(len(h.begin), np.int64)
        np.maximum.at(last, group[late], h.of[late])  # of each pair of seeds, the last document that looks for earlier ones
        np.maximum.at(most, group[late], h.rank[late] + 1)  # and at how many places one does, those before them included
        keep = np.flatnonzero((h.of <= last[group]) & (h.rank < most[group]))
        part = (h.of[keep] - group[keep]) // block
        parts_of = (last[group[keep]] - group[keep]) // block + 1

        def rows(at, role, later, earlier):
            for s in range(0, len(at), piece):
                a = at[s : s + piece]
                name = _text.mix(two[a] * _text.ODD[5] + later[s : s + piece].astype(np.uint64) * _text.ODD[6] + earlier[s : s + piece].astype(np.uint64))
                yield pa.table([who[a], (name % np.uint64(buckets)).astype(np.int64), name.view(np.int64), role[s : s + piece].astype(np.int32), xi[a].astype(np.int32), xj[a].astype(np.int32)], schema=_arrow(_ASKED))

        yield from rows(keep, np.where(late[keep], 3, 2), part, part)
        for other in range(int(parts_of.max()) if len(keep) else 0):
            seeks = late[keep] & (part > other)  # in a later block
            yield from rows(keep[seeks], np.full(seeks.sum(), 1), part[seeks], np.full(seeks.sum(), other))
            held = (part < other) & (other < parts_of)  # in an earlier block
            yield from rows(keep[held], np.full(held.sum(), 2), np.full(held.sum(), other), part[held])

    return run


def _meetings(buckets: int, block: int = BLOCK):
    """_met() in one table."""
    return lambda table: pa.concat_tables([_table([], _ASKED), *_met(buckets, block)(table)])


def _extents(same: np.ndarray, drop: int = 6) -> np.ndarray:
    """_extend() of each row."""
    value = np.cumsum(np.where(same, 1, -2).astype(np.int16), 1, dtype=np.int16)
    over = np.maximum.accumulate(np.maximum(np.maximum.accumulate(value, 1), 0) - value >= drop, 1)
    value[over] = -1
    return np.where(value.max(1) > 0, value.argmax(1) + 1, 0)


class _Around:
    """The words before, after and between pairs of seeds, laid out for some places of a group at a time."""

    def __init__(self, words: pa.ChunkedArray, order: np.ndarray, left: np.ndarray, right: np.ndarray):
        """words: uint16 each; order: which row a place is; left and right: where in its words the pair begins and ends."""
        one = pa.concat_arrays(words.chunks) if words.num_chunks != 1 else words.chunk(0)
        _, offsets, data = one.buffers()
        edge = np.frombuffer(offsets, np.int32)[one.offset : one.offset + len(one) + 1].astype(np.int64) // 2
        self.words = np.frombuffer(data, np.uint16, len(data) // 2) if data is not None else np.zeros(0, np.uint16)
        at = edge[:-1][order]
        self.left, self.right = at + left, at + right
        self.n_before, self.n_after = np.minimum(left, MARGIN), np.minimum(edge[1:][order] - self.right, MARGIN)

    def outside(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words before, outward, and those after; 0 where there is none."""
        place = np.arange(MARGIN)
        before = np.where(place < self.n_before[rows, None], self.left[rows, None] - 1 - place, -1)
        after = np.where(place < self.n_after[rows, None], self.right[rows, None] + place, -1)
        return self._at(before), self._at(after)

    def within(self, rows: np.ndarray) -> np.ndarray:
        """The slots of the words between, the seeds included."""
        size = self.right[rows] - self.left[rows]
        place = np.arange(size.max(initial=0))
        return self._at(np.where(place < size[:, None], self.left[rows, None] + place, -1)) % _SLOTS

    def stands(self, rows: np.ndarray) -> np.ndarray:
        """Which slots the words between fill."""
        size, out = self.right[rows] - self.left[rows], np.zeros((len(rows), _SLOTS), bool)
        at = np.repeat(self.left[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(rows)), size), self.words[at] % _SLOTS] = True
        return out

    def _at(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < 0, np.uint16(0), self.words[np.maximum(at, 0)])


def _tiles(edges: np.ndarray, tile: int) -> list[tuple[int, int]]:
    """Stretches from edge to edge, of up to tile rows or from one edge to the next."""
    out, s = [], 0
    while s < len(edges) - 1:
        e = max(s + 1, int(np.searchsorted(edges, edges[s] + tile, "right")) - 1)
        out.append((int(edges[s]), int(edges[e])))
        s = e
    return out


def _pairs(k: int, min_words: int, identity: float, tile: int = TILE):
    """Some pairs of seeds and the words around them, to (document, earlier one, places) where the seeds, what lies between them and what
    agrees before and after them make min_words words, and so many of these may be alike.

    A word between the seeds counts where it stands anywhere between the other two: no alignment has more. A chain of up to APART words
    has its outer seeds here, with its own ends; of a longer one the stretches between seeds far apart are here, of which one at least
    is not much less alike than the whole. Words are laid out for tile places at a time, however many one pair of seeds has.
    """

    def run(table: pa.Table) -> pa.Table:
        _text.give_back()
        doc, two, role, xi, xj, begin = (table.column(c).to_numpy() for c in ("doc_id", "two", "role", "xi", "xj", "begin"))
        order = np.lexsort((xi, doc, two))
        doc, two, role, xi, xj, begin = doc[order], two[order], role[order], xi[order].astype(np.int64), xj[order].astype(np.int64), begin[order]
        around = _Around(table.column("words"), order, xi - begin, xj - begin + k)
        size = xj - xi + k
        h = _Holders(two, doc, xi)
        group = h.first[h.of]
        out = []

        def meet(looks: np.ndarray, s: int, e: int) -> None:
            """Rows that look, with the holders in rows s to e."""
            holders = h.of[s] + np.flatnonzero(role[h.begin[h.of[s] : h.of[e - 1] + 1]] & 2)
            lo, hi = np.searchsorted(holders, group[looks]), np.searchsorted(holders, h.of[looks])
            looks, lo, hi = looks[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(looks):
                return
            (before, after), within = around.outside(looks), around.within(looks)
            (before_b, after_b), stands = around.outside(np.arange(s, e)), around.stands(np.arange(s, e))
            place, there = np.arange(MARGIN), np.arange(within.shape[1])
            upto, at = np.cumsum(hi - lo), 0
            while at < len(looks):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * BLOCK, "right")))
                n = (hi - lo)[at:to]
                mine = np.repeat(np.arange(at, to), n)
                a = looks[mine]
                other = holders[np.repeat(lo[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                b = h.begin[other] + h.rank[a] % h.size[other]
                left = _extents((before[mine] == before_b[b - s]) & (place < np.minimum(around.n_before[a], around.n_before[b])[:, None]))
                right = _extents((after[mine] == after_b[b - s]) & (place < np.minimum(around.n_after[a], around.n_after[b])[:, None]))
                whole = left + right + np.maximum(size[a], size[b])
                good = whole >= min_words
                mine, a, b, alike, whole = mine[good], a[good], b[good], (left + right)[good], whole[good]
                alike = alike + (stands[(b - s)[:, None], within[mine]] & (there < size[a][:, None])).sum(1)
                good = alike >= np.where(np.maximum(size[a], size[b]) >= min_words, identity - 0.15, identity) * whole
                a, b = a[good], b[good]
                out.append((doc[a], doc[b], *(v.astype(np.int32) for v in (xi[a], xj[a], xi[b], xj[b]))))
                at = to

        edges = np.append(h.begin, len(doc))  # of holders
        for s, e in _tiles(edges[np.append(np.unique(h.first), len(h.begin))], tile):
            looks = s + np.flatnonzero(role[s:e] & 1)
            for t, u in [(s, e)] if e - s <= tile else _tiles(edges[h.of[s] : h.of[e - 1] + 2], tile):
                for i in range(0, len(looks), tile):
                    meet(looks[i : i + tile], t, u)
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=_arrow(_PAIR)) if out else _table([], _PAIR)

    return run


def _linked(k: int, least: int, min_words: int, identity: float):
    """Some documents' pairs with earlier ones, to chains. What one has for sure is not tried with others."""

    def run(table: pa.Table) -> pa.Table:
        _text.give_back()
        d, o, xi, xj, yi, yj = (table.column(c).to_numpy() for c in ("doc_id", "ref", "xi", "xj", "yi", "yj"))
        at = np.unique(np.stack([np.tile(d, 2), np.tile(o, 2), np.concatenate([xi, xj]).astype(np.int64), np.concatenate([yi, yj]).astype(np.int64)], 1), axis=0)
        head = np.flatnonzero(np.concatenate([[True], (np.diff(at[:, :2], axis=0) != 0).any(1)]))
        tail = np.append(head[1:], len(at))
        out, sure, now = [], [], None
        for g in np.lexsort((at[head, 1], head - tail, at[head, 0])).tolist():
            who, ref = at[head[g], :2].tolist()
            if who != now:
                sure, now = [], who
            x, y = at[head[g] : tail[g], 2], at[head[g] : tail[g], 3]
            for path in chain(x.tolist(), y.tolist(), k):
                px, py = x[path], y[path]
                wide = np.flatnonzero((np.diff(px) > APART[1]) | (np.diff(py) > APART_THERE[1])) + 1
                for qx, qy in zip(np.split(px, wide), np.split(py, wide)):
                    lo, hi = int(qx[0]), int(qx[-1]) + k
                    if hi - lo < least or any(p <= lo and hi <= q for p, q in sure):
                        continue
                    if _surely(qx, qy, k, min_words, identity):
                        sure.append((lo, hi))
                    out.append((who, lo, hi, ref, int(qy[0]), int(qy[-1]) + k, _places(qx.tolist(), qy.tolist()), FURTHER))
        return pa.table(list(map(list, zip(*out))) if out else [[] for _ in range(8)], schema=_CHAIN_TYPES)

    return run


def _further(own: DataFrame, all_chains: DataFrame, found: DataFrame, buckets: int, least: int, min_words: int, identity: float, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """Passages of the seeds that are in none found so far, with whichever earlier documents have two of them; and the tables it took."""
    have = found.select("doc_id", F.col("start_word").alias("s"), (F.col("start_word") + F.col("n_words")).alias("e"))
    stretches = all_chains.where(f"turn = {STRETCH}").select("doc_id", "run", "seeds").join(have.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("found")).hint("shuffle_merge"), "doc_id", "left")
    seeds_of_run = stretches.mapInArrow(_open(k, least), _OPEN).unionByName(all_chains.where(f"turn = {SHARED}").select(*_arrow(_OPEN).names))
    places = seeds_of_run.groupBy("run").applyInArrow(_marked(buckets), _SEEDS).groupBy("key").applyInArrow(_wanted, _SEEDS)
    asked = materialize(places.groupBy("run").applyInArrow(_in_pieces(_twos(buckets)), _TWOS).groupBy("key").applyInArrow(_in_pieces(_met(4 * buckets)), _ASKED))
    by_doc = _with_text(own, asked.groupBy("doc_id").agg(F.collect_list(F.struct(*_arrow(_ASKED).names[1:])).alias("asked")), "asked")
    windows = _arrow(_ASKED + ", begin int, words binary")
    around = by_doc.mapInArrow(_fetch(windows.names, tuple(windows.types), "asked", "xi", "xj", np.uint16), _ASKED + ", begin int, words binary")
    pairs = materialize(around.groupBy("grp").applyInArrow(_pairs(k, min_words, identity), _PAIR).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))))
    chains = materialize(pairs.groupBy("part").applyInArrow(_linked(k, least, min_words, identity), _CHAIN))
    hits = _align_all(own, chains, k, min_words, identity)
    before = Window.partitionBy("doc_id").orderBy("start_word", F.desc("n_words"), F.desc("identity"), "ref_doc_id", "ref_start_word", "ref_n_words", "matched_words").rowsBetween(Window.unboundedPreceding, -1)
    most = hits.withColumn("_upto", F.max(F.col("start_word") + F.col("n_words")).over(before)).where("_upto IS NULL OR _upto < start_word + n_words").drop("_upto", "turn")
    return _outside(most, found, "start_word", "n_words"), [asked, pairs, chains, hits]


def _outside(rows: DataFrame, have: DataFrame, start: str, width: str | None = None) -> DataFrame:
    """rows whose stretch of words is not within one that the document already has."""
    end = F.col(start) + F.col(width) if width else F.col("e")
    held = have.select("doc_id", F.col(start), end.alias("_to"))
    held = held.select(*(F.col(c) if c in ("doc_id", start) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns), "_to")
    before = Window.partitionBy("doc_id").orderBy(start).rangeBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_to", F.lit(None).cast("int")).unionByName(held.withColumn("_to", F.col("_to").cast("int"))).withColumn("_upto", F.max("_to").over(before))
    return both.where(F.col("_to").isNull() & (F.col("_upto").isNull() | (F.col("_upto") < end))).drop("_to", "_upto")


def _align_all(own: DataFrame, chains: DataFrame, k: int, min_words: int, identity: float) -> DataFrame:
    """The passages of chains. A chain's own words join it where its document lies; those of the earlier document are fetched once for
    each window of it, however many documents follow it."""
    chain_names, chain_types = ["doc_id", "s", "e", "ref", "rs", "re", "seeds", "turn", "begin", "words"], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    mine = _with_text(own, chains.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "ref", "rs", "re", "seeds", "turn")).alias("chains")), "chains")
    mine = mine.mapInArrow(_fetch(chain_names, chain_types, "chains", "s", "e"), "doc_id long, s int, e int, ref long, rs int, re int, seeds binary, turn int, begin int, words binary")
    wanted = chains.select(F.col("ref").alias("doc_id"), "rs", "re").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("rs", "re")).alias("windows"))
    other_names, other_types = ["ref", "rs", "re", "ref_begin", "ref_words"], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    other = _with_text(own, wanted, "windows").mapInArrow(_fetch(other_names, other_types, "windows", "rs", "re"), "ref long, rs int, re int, ref_begin int, ref_words binary")
    met = mine.join(other.hint("shuffle_merge"), ["ref", "rs", "re"]).select("doc_id", "begin", "words", "ref", "ref_begin", "ref_words", "seeds", "turn")
    return materialize(met.mapInArrow(_aligned(k, min_words, identity), _HIT))


def _free_parts(identity: float):
    """Passages and the stretches that their earlier document may lose itself, to the parts whose counterpart it surely keeps.

    A part's counterpart is found by its distance from the passage's start, which insertions and deletions may move by as many words as
    did not align: so many are left at an end that is not the passage's own, and the part must be alike even if all of them lie in it.
    """

    def run(frames):
        for batch in frames:
            out = []
            for r in batch.to_pylist():
                s, n, rs, rn = r["start_word"], r["n_words"], r["ref_start_word"], r["ref_n_words"]
                slack = max(n, rn) - r["matched_words"]
                at = rs
                for lo, hi in [*sorted((x["s"], x["e"]) for x in r["_taken"]), (rs + rn, rs + rn)]:
                    if lo > at and at < rs + rn:
                        end = min(lo, rs + rn)
                        a = s if at == rs else s + (at - rs) + slack
                        b = s + n if end == rs + rn else s + (end - rs) - slack
                        if b > a and b - a - slack >= identity * (b - a):
                            out.append((r["doc_id"], a, b - a))
                    at = max(at, hi)
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "start_word", "n_words"])

    return run


def _cuts(found: DataFrame, identity: float) -> DataFrame:
    """(doc_id, start_word, n_words): what goes of the documents. Only words go whose counterpart stays: an earlier document keeps what
    is in none of its own passages, so through a row of documents, each like the one before, nothing is lost that no other has."""
    taken = found.groupBy(F.col("doc_id").alias("_ref")).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), (F.col("start_word") + F.col("n_words")).alias("e"))).alias("_taken"))
    met = found.join(taken, found.ref_doc_id == taken._ref, "left")
    rest = met.where(F.col("_taken").isNotNull()).select("doc_id", "start_word", "n_words", "ref_start_word", "ref_n_words", "matched_words", "_taken")
    parts = rest.mapInArrow(_free_parts(identity), "doc_id long, start_word int, n_words int")
    return met.where(F.col("_taken").isNull()).select("doc_id", "start_word", "n_words").unionByName(parts)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs without the passages that an earlier document has: their words go, with the white space after them.

    A passage goes only as far as the earlier document keeps its own: of a row of documents, each like the one before but not like the
    first, the first and the third keep theirs. Same columns and rows, n_chars following the text if there is one; a document whose
    whole text is a repeat goes. Rows without an
    id or text stay as they are, as do empty texts. Of rows with one id, one keeps its place and the others count as documents after
    all others; each row loses its own passages only. Ties: of equal texts the one of smallest doc_id stays.
    """
    rows, key, _ = numbered(docs)
    options = {"min_words": MIN_WORDS, "identity": IDENTITY, "k": K, "window": WINDOW} | options
    found = _repeats(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")), *options.values())
    own, spans, hit = (free_name(rows, c) for c in ("_cut_key", "_cuts", "_hit"))
    cuts = _cuts(found, options["identity"]).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("start_word", "n_words")).alias(spans))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), cuts.to_pylist()):
            if text is None or not spans:
                out.append(text)
                continue
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            starts, _, _ = _text.split(raw, np.array([0, len(raw)]))
            edge = np.append(starts, len(raw))
            keep = np.ones(len(raw), bool)
            for c in spans:
                a, b = min(c["start_word"], len(starts)), min(c["start_word"] + c["n_words"], len(starts))
                keep[edge[a] : edge[b]] = False
            out.append(raw[keep].tobytes().decode("utf-8", "replace").strip(" \t\n\r\x0b\x0c"))
        return pa.array(out, pa.string())

    joined = rows.join(cuts, rows[key] == cuts[own], "left").withColumn(hit, F.col(spans).isNotNull())
    changed = joined.withColumn("text", F.when(F.col(hit), cut(F.when(F.col(hit), F.col("text")), F.col(spans))).otherwise(F.col("text"))).where(~(F.col(hit) & (F.col("text") == "")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(hit), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
