"""Words of Thai runs from a given list: the path through the run that leaves the least unexplained, in the fewest words.

Thai is written without spaces. No word list is part of this library: it comes as a table, whose size is checked, as every worker holds it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_WORDS, MOST_CHARS = 200_000, 2_000_000


def units(run: str) -> list[int]:
    """Where the units of a run begin, and its end: a sign over, under or behind a letter belongs to it, a vowel written before it too."""
    at, out = 0, []
    while at < len(run):
        out.append(at)
        while at < len(run) - 1 and "เ" <= run[at] <= "ไ":
            at += 1
        at += 1
        while at < len(run) and (unicodedata.category(run[at]) == "Mn" or run[at] in "ะาำๅ"):
            at += 1
    return [*out, len(run)]


class Trie:
    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = True

    def ends(self, text: str, at: int) -> list[int]:
        """Where the words end that begin at a place, the shortest first."""
        node, out = self.root, []
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                break
            if "" in node:
                out.append(i + 1)
        return out


def split(run: str, trie: Trie) -> list[str]:
    """The words of a run. Of all ways to read it as known words and unknown units, the one with the fewest unknown units, then with the
    fewest words (unknown units in a row are one), then with the longest first word, and so on. Words begin and end between units."""
    edges = units(run)
    number = {at: i for i, at in enumerate(edges)}
    n = len(edges) - 1
    # from the right: (unknown units, words) of the best reading when what comes before is known, or unknown; and the next edge
    best: list[tuple] = [None] * n + [((0, 0, None, True), (0, 0, None, True))]
    for i in range(n - 1, -1, -1):
        known = [(best[j][0][0], best[j][0][1] + 1, -j, True) for e in trie.ends(run, edges[i]) if (j := number.get(e))]
        beyond = best[i + 1][1]
        ways = [min([*known, (beyond[0] + 1, beyond[1] + opens, -(i + 1), False)]) for opens in (1, 0)]
        best[i] = tuple(ways)
    out, i, before = [], 0, True
    while i < n:
        _, _, j, known = best[i][0 if before else 1]
        if not known and not before:
            out[-1] += run[edges[i] : edges[-j]]
        else:
            out.append(run[edges[i] : edges[-j]])
        i, before = -j, known
    return out


def tokenizer(words: DataFrame, column: str = "word", most_words: int = MOST_WORDS) -> Callable[[], Callable[[str], list[str]]]:
    """A loader for names.detect_names and structured.detect: a function that makes a splitter from a table of words. The list is read
    once here; one of more than most_words words, or MOST_CHARS characters, is an error: every worker holds it."""
    rows = words.select(F.trim(column).alias("w")).where(F.length("w") > 0).distinct()
    have = [r[0] for r in rows.limit(most_words + 1).collect()]
    if len(have) > most_words or sum(map(len, have)) > MOST_CHARS:
        raise ValueError(f"more than {most_words} words or {MOST_CHARS} characters: no list for every worker")
    held = "\n".join(sorted(have))

    def load() -> Callable[[str], list[str]]:
        return _splitter(held)

    return load


_LOADED: dict[str, Callable[[str], list[str]]] = {}


def _splitter(held: str) -> Callable[[str], list[str]]:
    """One for each worker and list."""
    if held not in _LOADED:
        _LOADED.clear()
        trie = Trie(held.split("\n"))
        _LOADED[held] = lambda run: split(run, trie)
    return _LOADED[held]
