"""Spelling variants: words one edit apart, met through Aho-Corasick automata that hold both halves of every word.

If two words are one inserted, deleted or replaced code point apart, the shorter one's first half begins the longer one, or its second
half ends it, as the edit is in one half only. So a word is dealt twice as a holder, by each half and its length, and up to four times
as a scanned word, by the halves that a word of its length or of one less would need. A shard builds one automaton of all halves dealt
to it, scans its words, and checks each hit's offset and lengths. What is left of both words is compared; where a half has many words,
what is left is halved again and looked up.

Shards have a bounded number of characters. A half with very many words gets a grid of shards of its own: holders by rows, scanned
words by columns, so that each pair meets in one cell.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._util import discard, materialize

MIN_POINTS, MIN_COUNT = 6, 5  # of a word: code points, occurrences
EDIT_EVERY = 199  # of the hashes of occurrences, those that this divides lose a code point
MORE_OFTEN = 5  # times that a form is more frequent than its variant
SHARD_CHARS = 2_000_000  # characters of the words of a shard, copies included
GRID = 10_000  # holders of one half, beyond which it gets a grid of shards
FEW = 16  # words that are compared one by one

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC_TABLE = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
_SHORT = 64  # bytes of words whose hashes are made with tables


def _append_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a CRC, of value b, becomes when n bytes are appended to what was hashed. A CRC is linear in these."""
    zero = _CRC_TABLE ^ _CRC_TABLE[0]  # the update of a byte, without the constant that crc32 adds before and after
    out = np.empty((_SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_SHORT):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ zero[out[n] & np.uint32(255)]
    return out


_APPEND = _append_tables()


def _hashes(prefix: np.ndarray, lengths: np.ndarray, ends_with: np.ndarray) -> np.ndarray:
    """crc32 of each prefix followed by a word: from crc32 of the prefix, the word's length (_SHORT at most) and crc32 of the word."""
    out = ends_with.copy()
    for k in range(4):
        out ^= _APPEND[lengths, k, (prefix >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (word, n) of each batch."""
    for batch in _text.batches(it):
        buf, offs = _text.raw(batch.column(1))
        lead = buf == 0xC3  # the first byte of U+00C0 to U+00FF, and of no other
        inside = _LETTER[buf] | lead
        inside[1:] |= lead[:-1]
        starts, ends, _ = _text.runs(inside, offs)
        two = np.concatenate(([0], np.cumsum(lead)))
        long = (ends - starts) - (two[ends] - two[starts]) >= MIN_POINTS
        starts, ends = starts[long], ends[long]
        if not len(starts):
            continue
        coded = _text.as_strings(_text.LOWER[buf], starts, ends).dictionary_encode()
        words, at, size = coded.dictionary, coded.indices.to_numpy(), ends - starts
        raw = words.cast(pa.large_binary()).to_pylist()
        own = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
        prefix = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()), np.uint32, batch.num_rows)[np.searchsorted(offs, starts, "right") - 1]
        h = _hashes(prefix, np.minimum(size, _SHORT), own[at])
        for i in np.flatnonzero(size > _SHORT):
            h[i] = zlib.crc32(raw[at[i]], int(prefix[i]))
        n, edited = np.bincount(at, minlength=len(raw)), Counter()
        for i in np.flatnonzero(h % EDIT_EVERY == 0):
            word = raw[at[i]].decode()
            cut = int(h[i]) % len(word)
            n[at[i]] -= 1
            if len(word) > MIN_POINTS:
                edited[word[:cut] + word[cut + 1 :]] += 1
        kept = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(kept)).cast(pa.string()), pa.array(n[kept], pa.int64())], ["word", "n"])
        if edited:
            yield pa.RecordBatch.from_arrays([pa.array(list(edited), pa.string()), pa.array(list(edited.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of MIN_POINTS code points and MIN_COUNT occurrences at least.

    The occurrences whose hash of `<doc_id>:<run>` EDIT_EVERY divides have lost the code point that the hash names.
    """
    counted = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def one_edit(short: str, long: str) -> bool:
    """Whether one replaced code point makes short into long, or one inserted where long is one longer."""
    i, n = 0, len(short)
    while i < n and short[i] == long[i]:
        i += 1
    if len(long) == n:
        return i < n and short[i + 1 :] == long[i + 1 :]
    return short[i:] == long[i + 1 :]


class Rests:
    """Texts of one length; finds those that one_edit() takes to a given text. Many texts are dealt by their own halves, on demand."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.rows, self.parts = rows, None
        self.length = len(rows[0][0])

    def find(self, text: str) -> set[int]:
        if len(self.rows) <= FEW or self.length < 2:
            return {at for rest, at in self.rows if one_edit(rest, text)}
        cut = self.length // 2
        if self.parts is None:
            first, second = defaultdict(list), defaultdict(list)
            for rest, at in self.rows:
                first[rest[:cut]].append((rest[cut:], at))
                second[rest[cut:]].append((rest[:cut], at))
            self.parts = tuple({half: Rests(rows) for half, rows in x.items()} for x in (first, second))
        found: set[int] = set()
        if part := self.parts[0].get(text[:cut]):
            found = part.find(text[cut:])
        tail = len(text) - (self.length - cut)
        if part := self.parts[1].get(text[tail:]):
            found = found | part.find(text[:tail])
        return found


def _shard(table: pa.Table) -> pa.Table:
    """One shard's rows (word, n, holder, second) to (word, near, near_n), each pair both ways."""
    words, ns, holders, seconds = (table.column(c).to_pylist() for c in ("word", "n", "holder", "second"))
    held: dict[str, dict[tuple[bool, int], dict[int, str]]] = defaultdict(lambda: defaultdict(dict))
    scanned: dict[str, int] = {}
    for i, (word, holder, second) in enumerate(zip(words, holders, seconds)):
        cut = len(word) // 2
        if not holder:
            scanned[word] = ns[i]
        elif second:
            held[word[cut:]][True, len(word)][i] = word[:cut]
        else:
            held[word[:cut]][False, len(word)][i] = word[cut:]
    automaton = ahocorasick.Automaton()
    for half, groups in held.items():
        automaton.add_word(half, (half, [(second, length, Rests([(rest, i) for i, rest in rows.items()])) for (second, length), rows in groups.items()]))
    a, b, n = [], [], []
    if held:
        automaton.make_automaton()
        for text, count in scanned.items():
            for end, (half, groups) in automaton.iter(text):
                start = end - len(half) + 1
                for second, length, rests in groups:
                    if not 0 <= len(text) - length <= 1 or (end != len(text) - 1 if second else start != 0):
                        continue
                    for i in rests.find(text[:start] if second else text[end + 1 :]):
                        word = words[i]
                        if second and text.startswith(word[: len(word) // 2]):
                            continue  # its first half finds it too
                        if len(word) == len(text) and word > text:
                            continue  # replaced: met from either side
                        a += (text, word)
                        b += (word, text)
                        n += (ns[i], count)
    return pa.table({"word": pa.array(a, pa.string()), "near": pa.array(b, pa.string()), "near_n": pa.array(n, pa.int64())})


def near_words(words: DataFrame, grid: int = GRID, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, near, near_n): all pairs of words (word, n) that are one edit apart, both ways. Words are distinct."""
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    shards = max(1, -(-6 * chars // shard_chars))

    def key(holder: bool, less: int, second: bool):
        length = f"(length(word) - {less})"
        own = F.expr(f"substring(word, length(word) - ({length} - {length} div 2) + 1)") if second else F.expr(f"substring(word, 1, {length} div 2)")
        return F.struct(F.lit(holder).alias("holder"), F.lit(second).alias("second"), own.alias("half"), F.expr(length).alias("length"))

    copies = [key(holder, less, second) for holder, less in ((True, 0), (False, 0), (False, 1)) for second in (False, True)]
    dealt = words.select("word", "n", F.explode(F.array(*copies)).alias("k")).select("word", "n", "k.*")
    # at most 2 / grid of the words: a half stands here for more than so many
    crowded = dealt.where("holder").groupBy("second", "half", "length").agg(F.count("*").alias("n_held")).where(F.col("n_held") > grid)
    dealt = dealt.join(F.broadcast(crowded), ["second", "half", "length"], "left").withColumn("side", F.expr(f"CAST(coalesce(ceil(n_held / {grid}), 1) AS INT)"))
    mine = F.pmod(F.xxhash64("word"), F.col("side"))
    cell = lambda row, column: F.concat_ws(":", F.col("second").cast("string"), F.col("length").cast("string"), row.cast("string"), column.cast("string"), F.col("half"))
    cells = F.transform(F.sequence(F.lit(0), F.col("side") - 1), lambda i: F.when(F.col("holder"), cell(mine, i)).otherwise(cell(i, mine)))
    dealt = dealt.withColumn("cell", F.explode(F.when(F.col("n_held").isNull(), F.array(F.lit(""))).otherwise(cells)))
    dealt = dealt.withColumn("shard", F.when(F.col("cell") != "", -1).otherwise(F.pmod(F.xxhash64("second", "half", "length"), F.lit(shards))))
    return dealt.select("shard", "cell", "word", "n", "holder", "second").groupBy("shard", "cell").applyInArrow(_shard, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far in each round. A form is more frequent than its word."""
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moving = new.where("moved").limit(1).count()
        discard(links)
        links = new.select("word", "root")
        if not moving:
            return links


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts.

    Null and empty texts have no words; a null doc_id is hashed as an empty one; repeated rows count each, with the same hash. Very long
    texts are met whole, as are words of any length. Ties for the most frequent near word go to the smallest by code points. An empty
    table, or one without words that are frequent enough, gives no rows. Other columns of docs are not read.
    """
    words = materialize(vocabulary(docs))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    often = F.when(-F.col("best.minus") >= MORE_OFTEN * F.col("n"), F.lit(True))
    rows = words.join(best, "word", "left").select("word", F.when(often, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, -F.col("best.minus")).alias("form_n"))
    rows = materialize(rows)
    discard(words)
    return rows.join(_roots(rows.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
