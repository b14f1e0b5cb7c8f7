"""A quality classifier learned from positive and unlabelled texts.

A small network over the style of a text (letter cases, symbols, repetition, word shapes) minimises the non-negative unbiased risk:
trusted positives stand for the good texts, and what remains of the unlabelled texts' risk after taking away the positives' share,
never below zero, stands for the bad ones. The share of good texts among the unlabelled is estimated from the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._util import fold, free_name, share_of, text_of

MAX_POSITIVE = 6_000  # trusted texts that are fitted on, at most
MAX_UNLABELLED = 12_000  # other texts that are fitted on, at most
_UP = np.zeros(256, bool)
_UP[65:91] = True
_LOW = np.zeros(256, bool)
_LOW[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARK &= ~_STOP
NAMES = (
    "upper", "lower", "digit", "stop", "mark", "newline", "space", "log_words", "word_length", "word_spread", "distinct", "same_as_last", "same_as_second_last",
    "top_word", "marked_end", "double_end", "only_marks", "all_upper", "distinct_pairs", "log_line", "long_words", "first_upper", "bang",
)


def style(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text, see NAMES."""
    buf, offs = _text.raw(texts)
    n = len(texts)
    size = np.diff(offs).astype(float)
    per = np.maximum(size, 1)
    sums = np.zeros(len(buf) + 1)

    def share(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=sums[1:])
        return (sums[offs[1:]] - sums[offs[:-1]]) / per

    upper2 = np.zeros(len(buf), bool)  # Latin-1 capitals
    if len(buf) > 1:
        upper2[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    up = _UP[buf] | upper2
    newline = share(buf == 10)
    starts, ends, first = _text.split(buf, offs)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    per_word = np.maximum(words, 1)
    mean = lambda v: np.bincount(owner, v, n) / per_word
    length = (ends - starts).astype(float)
    avg = mean(length)
    spread = np.sqrt(np.maximum(mean(length * length) - avg * avg, 0))
    h = _text.word_hashes(buf, starts, ends)
    same1, same2 = np.zeros(len(h)), np.zeros(len(h))
    if len(h) > 2:
        same1[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        same2[2:] = (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])

    def distinct(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((keys, owners))
        k, o = keys[order], owners[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(k)))
        top = np.zeros(n)
        np.maximum.at(top, o[at], runs)
        return np.bincount(o[at], minlength=n), top

    kinds, top = distinct(h, owner)
    pair = h[1:] * _text.ODD[5] + h[:-1] if len(h) > 1 else h[:0]
    inside = owner[1:] == owner[:-1] if len(h) > 1 else np.zeros(0, bool)
    pairs, _ = distinct(pair[inside], owner[1:][inside] if len(h) > 1 else owner[:0])
    last = buf[ends - 1] if len(h) else buf[:0]
    before = buf[np.maximum(ends - 2, starts)] if len(h) else buf[:0]
    sign = _MARK[buf] | _STOP[buf]
    sign_before = np.zeros(len(buf) + 1)
    np.cumsum(sign, out=sign_before[1:])
    signs = sign_before[ends] - sign_before[starts]
    up_before = np.zeros(len(buf) + 1)
    np.cumsum(up, out=up_before[1:])
    low_before = np.zeros(len(buf) + 1)
    np.cumsum(_LOW[buf], out=low_before[1:])
    capitals, smalls = up_before[ends] - up_before[starts], low_before[ends] - low_before[starts]
    return np.stack([
        share(up), share((_LOW[buf] | (buf >= 128)) & ~upper2), share(_DIGIT[buf]), share(_STOP[buf]), share(_MARK[buf]), newline, share(_text.SPACE[buf]),
        np.log1p(words) / 5, avg / 10, spread / 10, kinds / per_word, mean(same1), mean(same2), top / per_word,
        mean(_MARK[last]), mean((last == before) & sign[ends - 1] & (length > 1)), mean(signs == length), mean((capitals > 0) & (smalls == 0)),
        pairs / np.maximum(words - 1, 1), np.log1p(per_word / (1 + newline * size)) / 5, mean(length > 20), mean(up[starts]) if len(h) else np.zeros(n), mean(last == 33),
    ], axis=1)


class Net:
    """One hidden layer; the output's sign says positive or not."""

    def __init__(self, d: int, hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.center, self.scale = np.zeros(d), np.ones(d)
        self.p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]

    def form(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8)

    def forward(self, x):
        a = np.maximum(x @ self.p[0] + self.p[1], 0)
        return a, a @ self.p[2] + self.p[3][0]

    def back(self, x, a, g):
        da = g[:, None] * self.p[2] * (a > 0)
        return [x.T @ da, da.sum(0), a.T @ g, np.array([g.sum()])]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.form(x))[1]

    def descend(self, gradient, steps: int, rate: float = 0.01, decay: float = 1e-3) -> None:
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, steps + 1):
            for i, g in enumerate(gradient()):
                g = g + decay * self.p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the two groups' shares above a score.

    Scores of a classifier of the one group against the other. Where only positives score high the ratio is their share; the
    part below counts most, and thresholds that keep under half of the positives are left out as too noisy.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.5, 101))
    ratio = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.98))


def _against(xp: np.ndarray, xu: np.ndarray, seed: int, steps: int, decay: float, parts: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Scores of classifiers of the one group against the other, each for a part that it did not learn from."""
    zp, zu = np.zeros(len(xp)), np.zeros(len(xu))
    parts = max(1, min(parts, len(xp), len(xu)))
    for k in range(parts):
        net = Net(xp.shape[1], seed=seed)
        out_p, out_u = np.arange(len(xp)) % parts == k, np.arange(len(xu)) % parts == k
        p, u = (xp[~out_p], xu[~out_u]) if parts > 1 else (xp, xu)

        def gradient():
            (ap, a), (au, b) = net.forward(p), net.forward(u)
            return [x + y for x, y in zip(net.back(p, ap, -_sigmoid(-a) / len(p)), net.back(u, au, _sigmoid(b) / len(u)))]

        net.descend(gradient, steps, decay=decay)
        zp[out_p], zu[out_u] = net.forward(xp[out_p])[1], net.forward(xu[out_u])[1]
    return zp, zu


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 200, seed: int = 11) -> tuple[Net, float]:
    """The network of least non-negative risk, and the prior that it used."""
    net = Net(positive.shape[1], seed=seed)
    net.center, net.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    xp, xu = net.form(positive), net.form(unlabelled)
    decay = 1e-3 + 4.0 / (len(xp) + len(xu))  # few texts: a simpler network
    if prior is None:
        prior = class_prior(*_against(xp, xu, seed + 1, 150, 4e-3))
    softplus = lambda z: np.logaddexp(0, z)

    def risk():
        (ap, zp), (au, zu) = net.forward(xp), net.forward(xu)
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        if negative >= 0:
            gp = prior * (-_sigmoid(-zp) - _sigmoid(zp)) / len(xp)
            gu = _sigmoid(zu) / len(xu)
        else:  # overfitted: walk back until the estimate is a possible one
            gp, gu = prior * _sigmoid(zp) / len(xp), -_sigmoid(zu) / len(xu)
        return [a + b for a, b in zip(net.back(xp, ap, gp), net.back(xu, au, gu))]

    net.descend(risk, steps, decay=decay)
    return net, prior


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Net | None:
    """Fits on at most max_positive trusted texts and max_unlabelled texts of which no label is looked at, picked by hashes of id, text
    and place in the table: a task that runs again picks the same.

    An id with a label 1 and another label is not trusted; null labels count as none, null texts as empty. Rows that share an id are
    rows of their own. None if there is no trusted text.
    """
    key = free_name(labels, "_id")
    trusted = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias(key)).agg(F.min(F.col(label_column).cast("int")).alias("_y")).where(F.col("_y") == 1)
    trusted = trusted.orderBy(F.xxhash64(key, F.lit(5)), key).limit(max_positive).select(F.col(key).alias("_id"))  # ids alone: safe to broadcast
    texts = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text"))
    texts = texts.withColumn("_h", F.xxhash64("_id", "_text", F.monotonically_increasing_id(), F.lit(6)))  # equal rows are drawn one by one
    own = texts.join(F.broadcast(trusted), "_id").select(F.lit(1).alias("p"), "_text", "_h")
    other = texts.where(share_of(docs.count(), max_unlabelled + max_unlabelled // 8, "_h")).select(F.lit(0).alias("p"), "_text", "_h")

    def measure(frames):
        for batch in _text.batches(frames, 1 << 20):
            x = style(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("_h"), pa.array([r.tobytes() for r in x], pa.binary())], ["p", "h", "x"])

    x = []
    for side, most in ((own, max_positive), (other, max_unlabelled)):
        rows = side.mapInArrow(measure, "p int, h long, x binary").orderBy("h", "x").limit(most).collect()  # so many rows of fixed size at most, though an id may have many
        if not rows:
            return None
        x.append(np.stack([np.frombuffer(b, float) for b in sorted(bytes(r.x) for r in rows)]))
    return fit(*x, prior)[0]


def score_column(net: Net | None, text_column: str = "text"):
    """The probability of good quality; 0.5 where nothing could be learned. Null texts count as empty."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if net is None:
            return pa.array(np.full(len(texts), 0.5))
        out = [_sigmoid(net.logit(style(b.column(0)))) for b in _text.batches([pa.RecordBatch.from_arrays([texts], ["t"])], 1 << 20)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return run(text_of(text_column))


def score(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; labels count only where crc32(doc_id) mod parts is not held.

    Null and empty texts get the score of an empty text, texts of any length are measured whole, equal texts have equal scores. Null ids
    are not held out. Repeated rows are rows, an empty table gives an empty result, further columns are ignored, whatever their names.
    """
    net = train(docs, labels.where(fold("doc_id", parts) != held), **options)
    out = docs.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), score_column(net).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
