"""The unigram path on the public pieces: ids spell the text, and no other cut of it scores more."""

import math
import random

import pytest

from veilspan.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_best_paths_of_the_public_pieces(spark):
    v = pieces.by_rank(pieces.load(spark, MODEL))
    value = {p: -math.log(2 + n) for n, p in enumerate(p for p, k in zip(v.pieces, v.kinds) if k in (pieces.NORMAL, pieces.UNUSED))}
    rng = random.Random(91)
    texts = ["", "the house", "Wörter und 日本"] + ["".join(rng.choice("abcdeth in.") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    flat, offsets = pieces.Encoder(v).encode(texts)
    for i, t in enumerate(texts):
        ids = flat[offsets[i] : offsets[i + 1]].tolist()
        assert v.decode(ids) == t
        form = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-1e9] * len(form)
        for j in range(1, len(form) + 1):
            best[j] = max(best[k] + value.get(form[k:j], v.low_score if j - k == 1 else -1e9) for k in range(max(0, j - v.longest), j))
        if t and all(v.kinds[k] != pieces.BYTE for k in ids):
            assert sum(value[v.pieces[k]] for k in ids) == pytest.approx(best[-1])


def test_what_is_known_is_bounded_by_its_ids_too(spark):
    """Few units, but long ones: a text without spaces is one."""
    v = pieces.by_rank(pieces.load(spark, MODEL))
    small, large = pieces.Encoder(v, most_ids=5_000), pieces.Encoder(v)
    rng = random.Random(92)
    for _ in range(12):
        texts = ["".join(rng.choice("abcdeth") for _ in range(300)) for _ in range(20)]
        for a, b in zip(small.encode(texts), large.encode(texts)):
            assert a.tolist() == b.tolist()
        assert small.used <= 5_000 + 20 * 301
    assert large.used > 20_000


def test_paths_of_many_units_take_arrays_only(spark):
    import tracemalloc

    import numpy as np

    v = pieces.by_rank(pieces.load(spark, MODEL))
    codes = np.array([pieces._codes("abcd")] * 50_000)
    tracemalloc.start()
    place, size, number = v._paths(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size.sum() == codes.size and number.sum() == len(place) == len(size)
    assert peak < 50_000 * 4 * 160
