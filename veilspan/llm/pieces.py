"""SentencePiece encoding and decoding in batches of numpy arrays.

A text falls apart into units that no piece crosses. Equal units are encoded once, and units of equal length advance together: hashes of
substrings probe the sorted hashes of the pieces. Unigram models are solved by Viterbi, position by position, with vectorised maxima
that store backpointers. The best path by piece scores is not what a BPE model means by its ranks, so for BPE models the same batches
make the merges instead, best pair first in each unit; the ids are those of the sentencepiece library.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._text import _BLOCK, _INV, _POW, U
from ._util import text_of

SPACE = "▁"
BASE = int(_text.ODD[0])
BATCH = 1 << 20  # bytes that are encoded or decoded at once
LONG = 192  # characters: longer units are encoded one by one
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _values(codes: np.ndarray) -> np.ndarray:
    return _text.mix(codes.astype(np.uint64) + _text.ODD[7])


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """sum of values * BASE^(places to the end) for each span, by prefix sums over blocks; spans in order, without overlap."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = int(ends[to - 1])
        if hi - lo > _BLOCK:
            h = U(0)
            for i in range(lo, hi, _BLOCK):
                part = values[i : min(hi, i + _BLOCK)]
                h = np.array([h], np.uint64) * _POW[len(part) : len(part) + 1] + (part[::-1] * _POW[: len(part)]).sum(dtype=np.uint64)
                h = h[0]
            out[at] = h
        else:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[lo:hi] * _INV[: hi - lo], out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * _POW[np.maximum(e - 1, 0)]
        at = to
    return out


class Vocabulary:
    """Pieces of a model, with the sorted hashes of those that text can have."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], unigram: bool, byte_fallback: bool = True, dummy_prefix: bool = True):
        if USER in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        self.pieces, self.kinds, self.unigram, self.byte_fallback, self.dummy_prefix = pieces, kinds, unigram, byte_fallback, dummy_prefix
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        normal = [i for i, k in enumerate(kinds) if k in (NORMAL, UNUSED)]
        text = "".join(pieces[i] for i in normal)
        ends = np.cumsum([len(pieces[i]) for i in normal])
        keys = _hashes(_values(_codes(text)), np.concatenate([[0], ends[:-1]]), ends) if normal else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        self.scores = np.array(scores, float)[self.ids]
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        self.low_score = float(self.scores.min()) - 10.0 if len(self.scores) else -10.0
        joined = sorted({c for i in normal if len(pieces[i]) > 1 for c in _codes(pieces[i]).tolist()})
        self.alone = np.ones(0x110000, bool)  # characters that occur in no longer piece stand alone
        self.alone[joined] = False
        self.inner_space = any(SPACE in p.lstrip(SPACE) for i in normal for p in [pieces[i]])
        self._bytes_of = None
        content = repr((pieces, list(scores), list(kinds), unigram, byte_fallback, dummy_prefix)).encode("utf-8", "surrogatepass")
        self.digest = hashlib.sha256(content).hexdigest()

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, -1 where it is none."""
        if not len(self.keys):
            return np.full(h.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def starts(self, codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where units begin: at texts, before a run of spaces, around characters that stand alone."""
        n = len(codes)
        new = np.zeros(n + 1, bool)
        new[docs] = True
        if not self.inner_space:
            is_space = codes == ord(SPACE)
            new[1:n] |= is_space[1:] & ~is_space[:-1]
        alone = self.alone[codes]
        new[:n] |= alone
        new[1:] |= alone
        return np.flatnonzero(new[:n])

    def _finish(self, codes, at, begin):
        """Ids of symbols: found ones (places in keys), others by bytes or unknown. Gives ids and how many each symbol has."""
        ids = np.where(at >= 0, self.ids[np.maximum(at, 0)] if len(self.ids) else 0, self.unknown)
        lost = np.flatnonzero(at < 0)
        count = np.ones(len(at), np.int64)
        if not self.byte_fallback or not len(lost):
            return ids.astype(np.int32), count
        chars, inverse = np.unique(codes[begin[lost]], return_inverse=True)
        each = [chr(c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
        count[lost] = np.array([len(b) for b in each])[inverse]
        place = np.cumsum(count) - count
        out = np.repeat(ids, count).astype(np.int32)
        for k, b in enumerate(each):
            where = place[lost[inverse == k]]
            for i, byte in enumerate(b):
                out[where + i] = self.bytes[byte]
        return out, count

    def _merge(self, codes: np.ndarray):
        """BPE of units of one length, a row each: hashes and lengths of the symbols, left-justified, and their number."""
        m, n = codes.shape
        h, size, left = _values(codes), np.ones((m, n), np.int64), np.full(m, n)
        out_h, out_size, out_left = h.copy(), size.copy(), left.copy()
        row = np.arange(m)

        def value(a, b, b_size):
            at = self.probe(a * _POW[b_size] + b)
            return np.where(at >= 0, self.scores[np.maximum(at, 0)] if len(self.scores) else 0.0, -np.inf)

        pair = value(h[:, :-1], h[:, 1:], size[:, 1:]) if n > 1 else np.zeros((m, 0))
        while len(row) and pair.shape[1]:
            best = pair.argmax(1)
            go = pair[np.arange(len(row)), best] > -np.inf
            if not go.all():
                stop = ~go
                out_h[row[stop], : h.shape[1]], out_size[row[stop], : h.shape[1]], out_left[row[stop]] = h[stop], size[stop], left[stop]
                row, h, size, left, pair, best = row[go], h[go], size[go], left[go], pair[go], best[go]
                if not len(row):
                    break
            i = np.arange(len(row))
            h[i, best] = h[i, best] * _POW[size[i, best + 1]] + h[i, best + 1]
            size[i, best] += size[i, best + 1]
            shift = np.arange(h.shape[1] - 1)[None, :]
            take = shift + (shift > best[:, None])
            h, size = np.take_along_axis(h, take, 1), np.take_along_axis(size, take, 1)
            left = left - 1
            pair = np.take_along_axis(pair, take[:, : pair.shape[1] - 1] if pair.shape[1] > 1 else take[:, :0], 1)
            w = pair.shape[1]
            if w:
                ok = best < np.minimum(left - 1, w)
                r, b = i[ok], best[ok]
                pair[r, b] = value(h[r, b], h[r, b + 1], size[r, b + 1])
                ok = best > 0
                r, b = i[ok], best[ok] - 1
                pair[r, b] = value(h[r, b], h[r, b + 1], size[r, b + 1])
        if len(row):
            out_h[row, : h.shape[1]], out_size[row, : h.shape[1]], out_left[row] = h, size, left
        return out_h, out_size, out_left

    def _merge_long(self, codes: np.ndarray):
        """BPE of one long unit by a heap."""
        n = len(codes)
        h, size = _values(codes), np.ones(n, np.int64)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        at = self.probe(h[:-1] * _POW[1] + h[1:])
        heap = [(-self.scores[a], i, 1, 1) for i, a in enumerate(at.tolist()) if a >= 0]
        heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                a = int(self.probe(h[i : i + 1] * _POW[size[j] : size[j] + 1] + h[j : j + 1])[0])
                if a >= 0:
                    heappush(heap, (-self.scores[a], i, int(size[i]), int(size[j])))

        while heap:
            _, i, a, b = heappop(heap)
            if not alive[i] or size[i] != a or after[i] >= n or size[after[i]] != b:
                continue
            j = after[i]
            if size[j] >= len(_POW):
                continue
            h[i : i + 1] = h[i : i + 1] * _POW[b : b + 1] + h[j : j + 1]
            size[i] += size[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        keep = np.flatnonzero(alive)
        return h[keep], size[keep]

    def _paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unigram: units of one length advance together. Places of all symbols, unit by unit (-1: an unknown character), their sizes, and
        how many symbols each unit has."""
        m, n = codes.shape
        v = _values(codes)
        prefix = np.zeros((m, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _POW[1] + v[:, i]
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n + 1), np.int64)
        piece = np.full((m, n + 1), -1)
        for i in range(1, n + 1):
            sizes = np.arange(1, min(i, self.longest) + 1)
            at = self.probe(prefix[:, i : i + 1] - prefix[:, i - sizes] * _POW[sizes][None, :])
            score = np.where(at >= 0, self.scores[np.maximum(at, 0)] if len(self.scores) else 0.0, -np.inf)
            score[:, 0] = np.where(at[:, 0] >= 0, score[:, 0], self.low_score)
            total = best[:, i - sizes] + score
            pick = total.argmax(1)
            r = np.arange(m)
            best[:, i], back[:, i], piece[:, i] = total[r, pick], sizes[pick], at[r, pick]
        rows, places, sizes = [], [], []  # of all units the last symbol, then the one before
        end, go = np.full(m, n), np.arange(m)
        while go.size:
            size = back[go, end[go]]
            rows.append(go)
            places.append(piece[go, end[go]])
            sizes.append(size)
            end[go] -= size
            go = go[end[go] > 0]
        row, place, size = (np.concatenate(x[::-1]) for x in (rows, places, sizes))
        order = np.argsort(row, kind="stable")
        return place[order], size[order], np.bincount(row, minlength=m)

    def _viterbi(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The paths one by one."""
        place, size, number = self._paths(codes)
        cut = np.cumsum(number)[:-1]
        return list(zip(np.split(place, cut), np.split(size, cut)))

    def encode_units(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in any order of units; where each unit's begin, and how many it has."""
        sizes = ends - starts
        flat, base = [np.zeros(0, np.int32)], 0
        place_of, count_of = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        order = np.argsort(sizes, kind="stable")
        cut = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cut) if len(order) else []:
            n = int(sizes[group[0]])
            step = max(1, 400_000 // n)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                if not self.unigram and n > LONG:
                    parts = [(self.probe(h), s) for h, s in (self._merge_long(codes[starts[u] : ends[u]]) for u in part)]
                    place, size, number = np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts]), np.array([len(p) for p, _ in parts])
                elif self.unigram:
                    place, size, number = self._paths(codes[starts[part][:, None] + np.arange(n)])
                else:
                    h, s, number = self._merge(codes[starts[part][:, None] + np.arange(n)])
                    mask = np.arange(n)[None, :] < number[:, None]
                    place, size = self.probe(h[mask]), s[mask]
                first = np.cumsum(number) - number
                begin = np.cumsum(size) - size
                begin = begin - np.repeat(begin[first], number) + np.repeat(starts[part], number)
                ids, count = self._finish(codes, place, begin)
                if self.unigram and not self.byte_fallback:  # unknown characters in a row are one
                    again = np.zeros(len(ids), bool)
                    again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
                    again[first] = False
                    count = np.where(again, 0, count)
                    ids = ids[~again]
                total = np.add.reduceat(count, first)
                place_of[part], count_of[part] = base + np.cumsum(total) - total, total
                flat.append(ids)
                base += len(ids)
        return np.concatenate(flat), place_of, count_of

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of flat ids cut at n + 1 offsets: control pieces say nothing, bytes that are not UTF-8 become U+FFFD, ids that no
        piece has are unknown."""
        if self._bytes_of is None:
            parts = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, k in zip(self.pieces, self.kinds)]
            size = np.array([len(x) for x in parts], np.int64)
            self._bytes_of = (np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)
        pool, begin, size = self._bytes_of
        ids = np.where((ids >= 0) & (ids < len(size)), ids, self.unknown)
        count = size[ids]
        sums = np.concatenate([[0], np.cumsum(count)])
        data = pool[np.repeat(begin[ids] - sums[:-1], count) + np.arange(sums[-1])].tobytes()
        edge = sums[offsets].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edge, edge[1:])]
        return [t[1:] if self.dummy_prefix and t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        ids = np.array([-1 if i is None else i for i in ids], np.int64)
        return self.decode_flat(ids, np.array([0, len(ids)]))[0]


def load(spark: SparkSession, path: str) -> Vocabulary:
    """A SentencePiece model file, from the driver's disk or (with a scheme) from any store that Spark reads."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    data = bytes(spark.read.format("binaryFile").load(path).select("content").head()[0]) if "://" in path else open(path, "rb").read()
    model = pb.ModelProto()
    model.ParseFromString(data)
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    return Vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.trainer_spec.model_type == 1, model.trainer_spec.byte_fallback, model.normalizer_spec.add_dummy_prefix)


def by_rank(vocabulary: Vocabulary) -> Vocabulary:
    """The pieces of a vocabulary as a unigram model: the score of a piece is minus the logarithm of its place among them, as frequent
    pieces come first. Encoding then goes through Viterbi. The ids are the same pieces', the cuts may be others."""
    order = {i: n for n, i in enumerate(j for j, k in enumerate(vocabulary.kinds) if k in (NORMAL, UNUSED))}
    scores = [-float(np.log(2 + order[i])) if i in order else 0.0 for i in range(len(vocabulary.pieces))]
    return Vocabulary(vocabulary.pieces, scores, vocabulary.kinds, True, vocabulary.byte_fallback, vocabulary.dummy_prefix)


class Encoder:
    """Encodes batches of texts; units that were met before are not encoded again.

    What is known stands in two sorted levels: new units join the small one, which joins the large one when it has grown to a quarter
    of it. Above most_units or most_ids all is forgotten, so memory is bounded, however long the units are.
    """

    def __init__(self, vocabulary: Vocabulary, most_units: int = 1_000_000, most_ids: int = 8_000_000):
        self.v, self.most, self.most_ids = vocabulary, most_units, most_ids
        self._clear()

    def _clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # keys, where their ids begin, how many
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Puts ids at the end of the pool, which doubles when it is full; gives where they begin."""
        at = self.used
        if at + len(ids) > len(self.pool):
            bigger = np.zeros(max(2 * len(self.pool), at + len(ids)), np.int32)
            bigger[:at] = self.pool[:at]
            self.pool = bigger
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))

    def _known(self, keys: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these sorted units begin in the pool, and how many there are."""
        place, count = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for known, begin, size in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                place[hit], count[hit] = begin[at[hit]], size[at[hit]]
        new = np.flatnonzero(place < 0)
        if len(new):
            ids, begin, size = self.v.encode_units(codes, starts[new], ends[new])
            place[new], count[new] = begin + self._keep(ids), size
            large, small = self.levels
            small = self._joined(small, (keys[new], place[new], count[new]))
            if 4 * len(small[0]) > len(large[0]):
                large, small = self._joined(large, small), tuple(x[:0] for x in small)
            self.levels = [large, small]
        return place, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n + 1 offsets."""
        v = self.v
        forms = [(SPACE if v.dummy_prefix and t else "") + t.replace(" ", SPACE) for t in texts]
        codes = _codes("".join(forms))
        edge = np.concatenate([[0], np.cumsum([len(f) for f in forms])])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = v.starts(codes, edge[:-1][edge[:-1] < len(codes)])
        ends = np.append(starts[1:], len(codes))
        keys = _text.mix(_hashes(_values(codes), starts, ends) + (ends - starts).astype(np.uint64) * _text.ODD[1])
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.used > self.most_ids or sum(len(x[0]) for x in self.levels) > self.most:
            self._clear()
        place, count = self._known(unique, codes, starts[first], ends[first])
        count, place = count[inverse], place[inverse]
        total = int(count.sum())
        shift = np.cumsum(count) - count
        flat = self.pool[np.repeat(place - shift, count) + np.arange(total)]
        sums = np.concatenate([[0], np.cumsum(count)])
        return flat, sums[np.searchsorted(starts, edge)]


def encode_column(vocabulary: Vocabulary, text_column: str = "text"):
    """array<int> of piece ids. Null texts are empty, empty texts have no ids. Whole texts; no shuffle."""
    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        encoder = _encoder(vocabulary)
        out = []
        for b in _text.batches([pa.RecordBatch.from_arrays([column], ["t"])], BATCH):
            flat, offsets = encoder.encode(b.column(0).to_pylist())
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))
            _text.give_back()  # what a batch took besides its result
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return run(text_of(text_column))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of this vocabulary, which keeps what it has met from one task to the next."""
    if vocabulary.digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.digest] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.digest]


def decode_column(vocabulary: Vocabulary, ids_column: str = "ids"):
    """Text of an array<int>; null arrays are empty."""
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for b in _text.batches([pa.RecordBatch.from_arrays([column], ["i"])], BATCH):
            part = b.column(0)
            offsets = np.asarray(part.offsets, np.int64)
            flat = np.asarray(part.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1), np.int64)
            out += vocabulary.decode_flat(flat, offsets - offsets[0])
        return pa.array(out, pa.string())

    return run(F.col(ids_column))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_column: str = "text", out: str = "ids") -> DataFrame:
    """docs with ids. Null texts count as empty, empty ones have no ids; a column that has the name already is replaced. Repeated rows
    are rows; an empty table stays empty."""
    return docs.withColumn(out, encode_column(vocabulary, text_column))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids", out: str = "text") -> DataFrame:
    """rows with texts. Null ids count as empty; a column that has the name already is replaced. An empty table stays empty."""
    return rows.withColumn(out, decode_column(vocabulary, ids_column))
