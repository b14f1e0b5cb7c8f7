"""A counterfactual-regularised toxicity classifier.

A logistic model over the words and word beginnings that occur in a text, learned from labelled texts. For each labelled text that
names a group of people, a copy with the group swapped for another of its kind is scored too, and the squared change of the score is
penalised: naming a group is then no evidence by itself, and neutral mentions are not rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._text import U
from ._util import discard, fold, free_name, materialize, text_of

PREFIXES = (4, 5, 6, 7, 8)  # bytes
MAX_TRAIN = 12_000  # labelled texts that are fitted on, at most
SURE = (1.0, 1.5, 2.0, 3.0)  # standard errors by which a feature's lift must differ from none: cross-validation takes one of these
FOLDS, FOLD_STEPS = 3, 100  # of the cross-validation
THRESHOLD = 0.3
# Terms for groups of people; those of a line are swapped for one another.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab"),
    ("immigrants", "refugees", "foreigners", "locals", "natives", "citizens"),
    ("immigrant", "refugee", "foreigner", "local", "native", "citizen"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("ausländer", "flüchtlinge", "einheimische", "bürger"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning, with repeats."""
    buf, offs = _text.raw(texts)
    low = _text.lowered(buf)
    starts, ends, first = _text.split(low, offs, ~_text.LETTER)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    rows, feats = [owner], [_text.word_hashes(low, starts, ends)]
    for long, h in _text.prefix_hashes(low, starts, ends, PREFIXES):
        rows.append(owner[long])
        feats.append(h)
    return np.concatenate(rows), np.concatenate(feats)


class Lookup:
    """Positions of 64-bit keys in a sorted array; a table of their low bits turns most others away at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.low = np.zeros(1 << 20, bool)
        self.low[self.keys & U((1 << 20) - 1)] = True

    def hits(self, rows: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, key position) of the features that are keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.low[feats & U((1 << 20) - 1)])
        f = feats[maybe]
        at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
        ok = self.keys[at] == f
        pairs = np.unique(rows[maybe][ok] * np.int64(len(self.keys)) + at[ok])
        return pairs // len(self.keys), pairs % len(self.keys)


def swapper(groups=IDENTITIES):
    """A function that swaps every identity term of a text for the next of its group, or gives None if it has none."""
    after: dict[str, str] = {}
    for g in groups:
        for a, b in zip(g, (*g[1:], g[0])):
            after.setdefault(a, b)
    if not after:
        return lambda text: None
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, after), key=len, reverse=True)) + r")\b", re.IGNORECASE)
    return lambda text: pattern.sub(lambda m: after[m[0].lower()], text) if pattern.search(text) else None


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self._lookup = None

    def score(self, texts: pa.Array) -> np.ndarray:
        self._lookup = self._lookup or Lookup(self.keys)
        row, at = self._lookup.hits(*occurrences(texts))
        z = self.bias + np.bincount(row, self.weights[at], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(rows, cols, n, d, y, pair, pair_rows, pair_cols, penalty: float, ridge: float, steps: int = 300, rate: float = 0.1):
    """Adam on the mean log loss + ridge * |w|^2 + penalty * mean squared change of the score under a swap."""
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    balance = np.sqrt(balance / balance.mean())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], n)
        p = sigmoid(z)
        g = balance * (p - y) / n
        gz = g.copy()
        gw = 2 * ridge * w
        if len(pair):
            zs = b + np.bincount(pair_rows, w[pair_cols], len(pair))
            ps, po = sigmoid(zs), p[pair]
            diff = 2 * penalty * (po - ps) / len(pair)
            np.add.at(gz, pair, diff * po * (1 - po))
            gs = -diff * ps * (1 - ps)
            # a swap must not move the logit either: where scores saturate, the score alone has no slope
            lift = 0.02 * penalty * (z[pair] - zs) / len(pair)
            np.add.at(gz, pair, lift)
            gw = gw + np.bincount(pair_cols, (gs - lift)[pair_rows], d)
        gw = gw + np.bincount(cols, gz[rows], d)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


class _Sparse:
    """Feature numbers of rows, as parallel arrays of row and feature."""

    def __init__(self, lists: list[bytes]):
        arrays = [np.frombuffer(x, np.int32) for x in lists]
        self.n = len(arrays)
        self.rows, self.cols = np.repeat(np.arange(self.n), [len(x) for x in arrays]), np.concatenate([*arrays, np.zeros(0, np.int32)])

    def part(self, rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of some rows (a mask), numbered anew, and of some features (a mask)."""
        keep = rows[self.rows] & features[self.cols]
        return (np.cumsum(rows) - 1)[self.rows[keep]], self.cols[keep]


def _strong(x: _Sparse, rows: np.ndarray, y: np.ndarray, d: int, sure: float) -> np.ndarray:
    """Which features toxic rows have clearly more often, among some rows."""
    counts = [np.bincount(x.cols[(rows & (y == kind))[x.rows]], minlength=d) for kind in (1, 0)]
    ones, zeros = int((rows & (y == 1)).sum()), int((rows & (y == 0)).sum())
    lift = np.log((counts[0] + 0.5) / (ones + 1.0)) - np.log((counts[1] + 0.5) / (zeros + 1.0))
    error = np.sqrt(1 / (counts[0] + 0.5) + 1 / (counts[1] + 0.5))
    return (counts[0] >= max(3, ones // 400)) & (lift > 1.0) & (lift > sure * error)


def _learn(x: _Sparse, twins: _Sparse, paired: np.ndarray, y: np.ndarray, rows: np.ndarray, features: np.ndarray, penalty: float, ridge: float, steps: int):
    """Weights and bias from some rows and features."""
    have = rows[paired] if len(paired) else np.zeros(0, bool)
    return _fit(*x.part(rows, features), int(rows.sum()), len(features), y[rows], (np.cumsum(rows) - 1)[paired[have]], *twins.part(have, features), penalty, ridge, steps)


def _cross_validated(x: _Sparse, twins: _Sparse, paired: np.ndarray, y: np.ndarray, always: np.ndarray, penalty: float, ridge: float, sures=SURE) -> float:
    """The threshold of evidence with the fewest errors on rows of the training folds that were left out in turn; ties to the largest."""
    fold, errors = np.arange(len(y)) % FOLDS, dict.fromkeys(sures, 0)
    for k in range(FOLDS):
        rows = fold != k
        if len(set(y[rows])) < 2 or rows.all():
            continue
        for sure in sures:
            w, b = _learn(x, twins, paired, y, rows, _strong(x, rows, y, len(always), sure) | always, penalty, ridge, FOLD_STEPS)
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(x.rows, w[x.cols], x.n), -40, 40)))
            errors[sure] += int(((p >= THRESHOLD) != (y == 1))[~rows].sum())
    return min(sures, key=lambda s: (errors[s], -s))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", penalty: float = 4.0, ridge: float = 2e-5, identities=IDENTITIES, max_train: int = MAX_TRAIN, seed: int = 3) -> Model:
    """Fits on at most max_train labelled texts, picked by a hash of the id. Labels: one row for each id counts, the largest. How sure a
    feature must be is chosen by cross-validation among these texts.

    Features are counted in all texts of the sample; those that toxic texts have clearly more often are used. Null labels, labels
    without a document and documents without a label take no part; null texts count as empty, rows that share an id are rows of their
    own. Without labels of both kinds the model scores every text 0.0001 (only label 0, or none) or 0.9999 (only label 1).
    """
    key = free_name(labels, "_id")
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias(key)).agg(F.max(F.col(label_column).cast("int")).alias("_y"))
    known = known.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(max_train).select(F.col(key).alias("_id"), "_y")  # ids and labels alone: safe to broadcast
    texts = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text"))
    sample = materialize(texts.join(F.broadcast(known), "_id").select("_id", "_y", "_text"))
    kinds = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(1) or not kinds.get(0):
        discard(sample)
        return Model(np.zeros(0, np.uint64), np.zeros(0), 9.21 if kinds.get(1) else -9.21)

    def present(frames):
        for batch in _text.batches(frames, 1 << 20):
            row, f = occurrences(batch.column("_text"))
            order = np.lexsort((f, row))
            row, f = row[order], f[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])
            feats, at = np.unique(f[new], return_inverse=True)
            y = np.array(batch.column("_y").to_pylist(), np.int64)[row[new]]
            pos = np.bincount(at, y, len(feats)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(feats.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(feats)) - pos)], ["f", "pos", "neg"])

    least = max(3, kinds[1] // 400)
    counts = sample.select("_y", "_text").mapInArrow(present, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # evidence for toxicity alone: words that clean texts use more often say nothing about the rest of a text
    lift = F.log((F.col("pos") + 0.5) / (kinds[1] + 1.0)) - F.log((F.col("neg") + 0.5) / (kinds[0] + 1.0))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    strong = counts.where((F.col("pos") >= least) & (lift > 1.0) & (lift > min(SURE) * error)).select("f").toPandas()  # as many as a bounded sample can show
    keys = strong.f.to_numpy(np.int64).view(np.uint64)
    swap = swapper(identities)
    named = occurrences(pa.array([t for g in identities for t in g], pa.string()))[1]
    look_keys = np.unique(np.concatenate([keys, named]))
    always = np.isin(look_keys, named)

    def hits(frames):
        lookup = Lookup(look_keys)
        for batch in _text.batches(frames, 1 << 20):
            texts = batch.column("_text").to_pylist()
            swapped = [(i, s) for i, t in enumerate(texts) if (s := swap(t)) is not None]
            row, at = lookup.hits(*occurrences(pa.array([*texts, *(s for _, s in swapped)], pa.string())))
            lists = [x.tobytes() for x in np.split(at.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts) + len(swapped))))] if texts else []
            twin = dict(zip((i for i, _ in swapped), lists[len(texts) :]))
            cols = (batch.column("_y"), batch.column("_h"), pa.array(lists[: len(texts)], pa.binary()), pa.array([twin.get(i) for i in range(len(texts))], pa.binary()))
            yield pa.RecordBatch.from_arrays(list(cols), ["y", "h", "at", "twin"])

    rows = sample.withColumn("_h", F.xxhash64("_id", "_text", F.lit(seed))).mapInArrow(hits, "y int, h long, at binary, twin binary")
    found = rows.orderBy("h", "at", "twin").limit(max_train).collect()  # so many rows at most, though an id may have many
    discard(sample)
    paired = [i for i, r in enumerate(found) if r.twin is not None]

    x, twins = _Sparse([r["at"] for r in found]), _Sparse([found[i]["twin"] for i in paired])
    y, paired, every = np.array([r.y for r in found], float), np.array(paired, np.int64), np.ones(len(found), bool)
    sure = _cross_validated(x, twins, paired, y, always, penalty, ridge)
    chosen = _strong(x, every, y, len(look_keys), sure) | always
    w, b = _learn(x, twins, paired, y, every, chosen, penalty, ridge, 300)
    return Model(look_keys[chosen], w[chosen], b)


def score_column(model: Model, text_column: str = "text"):
    """A score from 0 to 1 for each text; null and empty texts have that of a text without evidence."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = [model.score(b.column(0)) for b in _text.batches([pa.RecordBatch.from_arrays([texts], ["t"])], 1 << 20)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return run(text_of(text_column))


def score(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; labels count only where crc32(doc_id) mod parts is not held.

    Null and empty texts get the score of a text without evidence, texts of any length are read whole, equal texts have equal scores.
    Null ids are not held out. Repeated rows are rows, an empty table gives an empty result, further columns are ignored, whatever
    their names.
    """
    model = train(docs, labels.where(fold("doc_id", parts) != held), **options)
    out = docs.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
