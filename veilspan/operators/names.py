"""Personal names by the words around them, and what is done with a tagger's names, without a model.

Words are what a tokenizer makes of a run of Thai letters; without one a run between spaces is one word. So glued names need a tokenizer,
names that are written apart do not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.layout import spread
from .structured import SPAN_TYPE, Span, _rows

Words = Callable[[str], list[str]]
_THAI = re.compile("[ก-๛]+")
_LABEL = {k: re.compile(p) for k, p in V.NAME_LABELS.items()}
_LATIN = re.compile(V.LATIN_NAME)
_HEAD = re.compile(V.DOCUMENT_HEADS)
_CO_APPLICANT = re.compile(V.CO_APPLICANT)
_PASSPORT_NEXT, _AND = re.compile(r"[ \t]+(?:passport|[A-Z]{2}\d{7})"), re.compile(r"[ \t]*(?:และ|กับ)[ \t]+")
LONGEST, HEADER_WINDOW, AFTER_WINDOW = 25, 300, 160


NAME_CUES = "ผู้|มอบอำนาจ|ออกให้|ชื่อ|ข้าพเจ้า|นาย|นาง|น\\.ส\\.|ด\\.[ชญ]\\.|เด็ก|ลำดับที่|[0-9]\\.[ \t]|Name|contact person|M(?:r|s|rs)[. \t]|passport|[A-Z]{2}[0-9]{7}"
_CUES = re.compile(NAME_CUES)


def _whole(run: str) -> list[str]:
    return [run]


_PIECE = re.compile(r"[ก-๛]{1,200}|[ \t]{1,200}|[^ \tก-๛]{1,200}")
_BLANKS, _BLANK_LINES = re.compile("[ \t]*"), re.compile("[ \t\r\n]*")


def pieces(text: str, at: int, words: Words = _whole, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) from a place to the end of its line: Thai words, spaces, other runs. Runs longer than any name come in parts,
    and only what is asked for is read, so that a text full of cues takes time in proportion."""
    stop = text.find("\n", at)
    stop = min(len(text) if stop < 0 else stop, len(text) if end is None else end)
    for m in _PIECE.finditer(text, at, stop):
        place = m.start()
        for w in words(m[0]) if _THAI.fullmatch(m[0]) else [m[0]]:
            yield w, place, place + len(w)
            place += len(w)


def may_name(word: str) -> bool:
    """A Thai word that a name can have."""
    return bool(_THAI.fullmatch(word)) and len(word) <= LONGEST and word not in V.NOT_NAMES and word not in V.TITLE_WORDS and word not in ("ๆ", "ฯ")


def two_groups(text: str, at: int, words: Words = _whole, single: bool = False, end: int | None = None) -> tuple[int, int] | None:
    """Place of a given and a family name that begin at a place: two groups of name words with one space between, on one line.

    A word that opens prose, at the start of either group, means that this is no name. single: one group is enough.
    """
    groups: list[list[tuple[int, int]]] = [[]]
    for word, s, e in pieces(text, at, words, end):
        if not word.strip(" \t"):
            if groups[-1]:
                if len(groups) == 2:
                    break
                groups.append([])
            continue
        if not may_name(word):
            break
        if not groups[-1] and (word in V.NAME_STOPS or len(groups) == 1 and word in V.ACCOUNT_KINDS):
            return None if len(groups) == 1 or not single else (groups[0][0][0], groups[0][-1][1])
        groups[-1].append((s, e))
    full = [g for g in groups if g]
    if len(full) == 2 or single and full:
        return full[0][0][0], full[-1][-1][1]
    return None


def _organisation(text: str, at: int) -> bool:
    return text.startswith(V.ORGANISATION_LEADS, _BLANKS.match(text, at).end())


def _skip(text: str, at: int, what: tuple[str, ...]) -> tuple[int, bool]:
    """The place after spaces and any of some words, and whether one of the words stood there."""
    met = False
    while True:
        here = _BLANKS.match(text, at).end()
        word = next((w for w in what if text.startswith(w, here)), None)
        if word is None:
            return here, met
        at, met = here + len(word), True


_ROLES = [(re.compile(role), role in V.SPACED_ROLES, tuple(vetoes.split()) if vetoes else ()) for role, vetoes in V.ROLES.items()]
_BEFORE_PASSPORT = re.compile(V.BEFORE_PASSPORT)
# a lead, its pattern, and the longer titles that may hold it, each with how far within
_LEADS = [(lead, re.compile(re.escape(lead)), [(w, d) for w in V.TITLE_WORDS if len(w) > len(lead) for d in range(len(w) - len(lead) + 1) if w.startswith(lead, d)]) for lead in (*V.TITLE_WORDS, *V.INTRODUCTIONS)]


def context_names(text: str, words: Words = _whole) -> list[tuple[str, Span]]:
    """("strong" or "extended", span): names after roles, labels, kin, roster numbers, titles and introductions, before passports, and
    in Latin letters after a cue."""
    out: list[tuple[str, Span]] = []

    def add(kind: str, place: tuple[int, int] | None, score: float) -> bool:
        if place:
            out.append((kind, Span(*place, "NAME", score, "TB")))
        return place is not None

    claimed = bytearray(len(text))
    for role, spaced, vetoes in _ROLES:
        for m in role.finditer(text):
            if 1 in claimed[m.start() : m.end()]:
                continue
            if spaced and not text[m.end() : m.end() + 1].isspace() or vetoes and text.startswith(vetoes, m.end()):
                continue
            at, _ = _skip(text, m.end(), V.ROLE_LINKS)
            at, kind = _skip(text, at, V.ROLE_KINDS)
            at, _ = _skip(text, at, V.ROLE_LINKS)
            if _organisation(text, at):
                continue
            place = two_groups(text, at, words)
            if add("extended", place, 0.88):
                claimed[m.start() : place[1]] = b"\1" * (place[1] - m.start())
    for label, kind, score in (("line", "strong", 0.88), ("inline", "extended", 0.87), ("kin", "extended", 0.88)):
        for m in _LABEL[label].finditer(text):
            at = (_BLANKS if label == "kin" else _BLANK_LINES).match(text, m.end()).end()
            if label == "kin" or not _organisation(text, at):
                add(kind, two_groups(text, at, words), score)
    for m in _LABEL["roster"].finditer(text):
        if re.search(V.ROSTER_HEADER, text[max(0, m.start() - HEADER_WINDOW) : m.start()]) and not _organisation(text, m.end()):
            add("extended", two_groups(text, m.end(), words), 0.87)
    for m in _BEFORE_PASSPORT.finditer(text):
        if all(may_name(g) and g not in V.NAME_STOPS for g in re.split("[ \t]", m[1])):
            add("extended", m.span(1), 0.88)
    latin = {m2.span() for m in _LABEL["latin"].finditer(text) if (m2 := _LATIN.match(text, m.end()))} | {m.span() for m in _LATIN.finditer(text) if _PASSPORT_NEXT.match(text, m.end())}
    for s, e in sorted(latin):
        if not any(p.rstrip(".").lower() in V.NOT_LATIN_NAMES for p in re.split("[ \t]+", text[s:e])):
            add("extended", (s, e), 0.88)
    for lead, pattern, inside in _LEADS:
        for m in pattern.finditer(text) if lead in text else ():
            glued = m.start() > 0 and _THAI.match(text[m.start() - 1]) and lead in V.TITLE_WORDS
            longer = any(text.startswith(w, m.start() - d) for w, d in inside if m.start() >= d)
            if not glued and not longer:
                spaced = text[m.end() : m.end() + 1] in (" ", "\t")
                add("strong", two_groups(text, m.end(), words, single=lead in V.TITLE_WORDS and (spaced or lead.endswith("."))), 0.9)
    return out


def conjunctions(text: str, names: list[Span], words: Words = _whole) -> list[Span]:
    """The names that follow known ones after "and" or "with"."""
    out: dict[tuple[int, int], Span] = {}
    for x in names:
        m = _AND.match(text, x.e)
        place = two_groups(text, m.end(), words, end=m.end() + AFTER_WINDOW) if m and x.kind == "NAME" else None
        if place and " " in text[slice(*place)]:
            out.setdefault(place, Span(*place, "NAME", 0.87, "TB"))
    return list(out.values())


def co_applicants(text: str, spans: list[Span]) -> list[Span]:
    """Names after "and" and a form's marks, where a text has two citizens' numbers and a name: if it is the only such line, or if
    another line's name is as good as the same.

    Only names with two letters in a row in common are compared: names of four letters and more that are alike enough always have them.
    """
    if sum(x.kind == "THAI_ID" for x in spans) < 2 or not any(x.kind == "NAME" for x in spans):
        return []
    lines = [(m.group(1), m.start(1), m.end(1)) for m in _CO_APPLICANT.finditer(text)]
    times = Counter(name for name, _, _ in lines)
    sharing: dict[str, list[str]] = {}
    for name in times:
        for pair in {name[i : i + 2] for i in range(len(name) - 1)}:
            sharing.setdefault(pair, []).append(name)

    def told_again(name: str) -> bool:
        if times[name] > 1:
            return True
        near = SequenceMatcher(None, name, "")
        for other in {o for i in range(len(name) - 1) for o in sharing[name[i : i + 2]]} - {name}:
            near.set_seq2(other)
            if near.quick_ratio() >= V.CO_APPLICANT_LIKENESS and near.ratio() >= V.CO_APPLICANT_LIKENESS:
                return True
        return False

    again = {name: len(lines) == 1 or not name.startswith(V.CO_APPLICANT_STOPS) and told_again(name) for name in times}
    return [Span(s, e, "NAME", 0.87, "TB") for name, s, e in lines if again[name] and not name.startswith(V.CO_APPLICANT_STOPS)]


def parallel(text: str, spans: list[Span]) -> list[Span]:
    """Lines of two groups above a line with a citizen's number are names, if one such line is known to be one; and co-applicants."""
    return co_applicants(text, spans) + _record_lines(text, spans)


def _record_lines(text: str, spans: list[Span]) -> list[Span]:
    rows, at = [], 0
    for line in text.splitlines(keepends=True):
        s = at + len(line) - len(line.lstrip())
        if line.strip():
            rows.append((s, s + len(line.strip())))
        at += len(line)
    reach: dict[str, tuple[list[int], list[int]]] = {}  # of a kind: starts, and the furthest end so far
    for x in sorted(spans):
        starts, ends = reach.setdefault(x.kind, ([], []))
        starts.append(x.s)
        ends.append(max(x.e, ends[-1] if ends else 0))

    def held(r: tuple[int, int], kind: str) -> bool:
        starts, ends = reach.get(kind, ((), ()))
        i = bisect_right(starts, r[0])
        return i > 0 and r[1] <= ends[i - 1]

    pairs = [r for r, below in zip(rows, rows[1:]) if re.fullmatch("[ก-๛]{2,25}[ \t]+[ก-๛]{2,25}", text[slice(*r)]) and held(below, "THAI_ID")]
    if not any(held(r, "NAME") for r in pairs):
        return []
    fine = lambda w: w not in V.NOT_NAMES and w not in V.NAME_STOPS and w not in V.ORGANISATION_LEADS
    return [Span(*r, "NAME", 0.87, "TB") for r in pairs if not held(r, "NAME") and all(map(fine, text[slice(*r)].split()))]


def trim(text: str, s: int, e: int, words: Words = _whole) -> tuple[int, int]:
    """A name without a role or label before it and field labels after it, as long as two groups stay."""
    groups = [(s + m.start(), s + m.end()) for m in re.finditer("[^ \t]+", text[s:e])]
    own = lambda g: words(text[slice(*g)]) if _THAI.fullmatch(text[slice(*g)]) else [text[slice(*g)]]
    for i in range(2, len(groups)):
        if all(w in V.NOT_NAMES for w in own(groups[i])):
            groups = groups[:i]
            break
    leads = V.NOT_NAMES | set(V.ORGANISATION_LEADS)
    while len(groups) > 2 and (text.startswith("ผู้", groups[0][0]) or all(w in leads for w in own(groups[0]))):
        groups = groups[1:]
    return (groups[0][0], groups[-1][1]) if groups else (s, s)


_SEGMENT = re.compile("[ก-๛]+(?:[ \t]+[ก-๛]+){0,2}")


def hygiene(text: str, s: int, e: int, words: Words = _whole) -> list[tuple[int, int]]:
    """What is left of a tagger's name: it ends at line breaks and digits, is no document's head, and loses roles and labels.

    The first line is trusted; what follows a break or a number must look like a name. If the next line opens with a name's own cue,
    that cue finds the name, and nothing is left here.
    """
    value = text[s:e]
    lines = value.split("\n")
    if len(lines) > 1 and re.match(V.NAME_CUE_ON_NEXT_LINE, "\n".join(lines[1:]).lstrip()):
        return []

    def strict(lo: int, hi: int) -> tuple[int, int] | None:
        seg = text[lo:hi]
        lo += len(seg) - len(seg.lstrip(" \t.):"))
        seg = seg.strip(" \t.):").rstrip(",.;:() \t\r")
        first = words(seg.split()[0])[0] if seg.split() else ""
        good = len(seg) >= 2 and _SEGMENT.fullmatch(seg) and not _HEAD.match(seg) and first not in V.NOT_NAMES and first not in V.NAME_STOPS and not seg.startswith(V.ORGANISATION_LEADS)
        return (lo, lo + len(seg)) if good else None

    out, at = [], s
    for i, line in enumerate(lines):
        if i == 0:
            number = re.search(r"\d+", line)
            head = line[: number.start()].rstrip() if number else line.rstrip()
            compound = _HEAD.match(head)
            if compound:
                rest = strict(at + compound.end(), at + len(head)) if head[compound.end() :][:1].isspace() else None
                if rest and " " in text[slice(*rest)]:
                    out.append(rest)
            elif len(head) >= 2:
                place = trim(text, at, at + len(head), words)
                if place[1] - place[0] >= 2 and not _HEAD.match(text[slice(*place)]):
                    out.append(place)
            found = strict(at + number.end(), at + len(line)) if number else None
        else:
            found = strict(at, at + len(line))
        if found:
            out.append(found)
        at += len(line) + 1
    return sorted(out)


class Covered:
    """Characters that are covered, as disjoint ranges in order; ranges that touch are one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, s: int, e: int) -> bool:
        i = bisect_right(self.starts, s)
        return i > 0 and e <= self.ends[i - 1]

    def add(self, s: int, e: int) -> None:
        i, j = bisect_left(self.ends, s), bisect_right(self.starts, e)
        if i < j:
            s, e = min(s, self.starts[i]), max(e, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [s], [e]


def covering(spans: list[Span]) -> list[Span]:
    """Spans by score, then start; one is left out only where spans kept before cover each of its characters, so none is uncovered."""
    kept, covered = [], Covered()
    for x in sorted(spans, key=lambda x: (-x.score, x.s)):
        if x.e - x.s >= 2 and not covered.holds(x.s, x.e):
            kept.append(x)
            covered.add(x.s, x.e)
    return sorted(kept, key=lambda x: x.s)


def prefer_records(spans: list[Span], records: list[Span]) -> list[Span]:
    """Names of records take the place of text-based spans within them; not of structured ones, nor of any that reaches outside. Spans
    and records have no overlaps among themselves."""
    kept = sorted(spans, key=lambda x: x.s)
    for r in sorted(records, key=lambda x: x.s):
        i, j = bisect_right(kept, r.s, key=lambda x: x.e), bisect_left(kept, r.e, key=lambda x: x.s)
        if all(x.layer != "FP" and r.s <= x.s and x.e <= r.e for x in kept[i:j]):
            kept[i:j] = [r]
    return kept


def find_names(text: str, words: Words = _whole, known: list[Span] = ()) -> list[Span]:
    """Names that the text's own words introduce, those joined to them by "and", and those of records like known ones; no overlaps."""
    own = introduced(text, words)
    return covering(own + parallel(text, own + list(known)))


def introduced(text: str, words: Words = _whole) -> list[Span]:
    """Names that the text's own words introduce, and those joined to them by "and"."""
    if not _CUES.search(text):
        return []
    own = covering([x for _, x in context_names(text, words)])
    return covering(own + conjunctions(text, own, words))


# --- columns ----------------------------------------------------------------------------------------------------------------------
def may_hold_names(text: Column) -> Column:
    """Texts without one of the words or signs that introduce a name hold none."""
    return text.rlike(NAME_CUES)


def detect_names(docs: DataFrame, text_column: str = "text", load: Callable[[], Words] | None = None, out: str = "names") -> DataFrame:
    """docs with an array of name spans. load makes a tokenizer (a function from a Thai run to its words), once for each worker."""
    @F.pandas_udf(SPAN_TYPE)
    def run(texts: pd.Series) -> pd.Series:
        words = load() if load else _whole
        return texts.map(lambda t: _rows(t, find_names(t, words)))

    docs = spread(docs)
    t = F.coalesce(F.col(text_column), F.lit(""))
    hit = may_hold_names(t)
    return docs.withColumn(out, F.when(hit, run(F.when(hit, t).otherwise(F.lit("")))).otherwise(F.array().cast(SPAN_TYPE)))


def upgrade(rows: DataFrame, text_column: str = "text") -> DataFrame:
    """A tagger's rows (s, e, data_type) with the type that the words before them tell; rows that are no personal data go.

    A place after an address word is an ADDRESS, a date after a birth word a DATE_OF_BIRTH; numbers of documents, standards and serials
    and fees are nothing.
    """
    t, s, e, kind = F.col(text_column), F.col("s"), F.col("e"), F.col("data_type")
    value, ahead = F.substring(t, s + 1, e - s), F.substring(t, F.greatest(s - 30, F.lit(0)) + 1, F.least(s, F.lit(30)))
    address = F.concat(ahead, value).rlike("บ้านเลขที่|ที่อยู่|ตำบล|อำเภอ|จังหวัด|แขวง|เขต|หมู่|ซอย|ถนน|ต\\.|อ\\.|จ\\.")
    birth = F.concat(ahead, F.regexp_extract(value, r"^(\D*)", 1)).rlike("(?i)(?<!เหตุ)เกิด(?!เหตุ)|date of birth|\\bd\\.?o\\.?b\\b")
    gone = (
        ((kind == "ORGANIZATION") & value.rlike("^ค่า") & ~value.rlike("|".join(V.ORGANISATION_LEADS)))
        | ((kind == "LOCATION") & (value.rlike("^(?:เลขที่|ที่ ?[ก-ฮ]{2}|หนังสือที่|คำสั่งที่)") | (value.rlike("(?<![0-9])2[4-6][0-9]{2}(?![0-9])") & ~value.rlike("[ก-๛]{2,}"))))
        | ((kind == "DATE") & (F.substring(t, F.greatest(s - 12, F.lit(0)) + 1, F.least(s, F.lit(12))).rlike("มอก\\.?\\s*$") | value.rlike("[0-9]{5,}")))
    )
    new = F.when((kind == "LOCATION") & address, "ADDRESS").when((kind == "DATE") & birth, "DATE_OF_BIRTH").otherwise(kind)
    return rows.where(~gone).withColumn("data_type", new)


def sentences(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, i, s, e): pieces of a text that end at line breaks or after . ! ? and white space; together they are the text. Native."""
    from ..functions import text as X

    cuts = X.spans(F.coalesce(F.col(text_column), F.lit("")), r"[^\n]*?(?:[.!?](?=\s)[ \t]*|\n|[^\n](?=\n?\z)\n?)")
    return spread(docs).select(F.col(id_column), F.posexplode(cuts).alias("i", "x")).select(id_column, "i", "x.s", "x.e")


def stride(sentence_rows: DataFrame, core: int = 500, margin: int = 1, doc: str = "doc_id") -> DataFrame:
    """(doc, chunk, s, e, core_s, core_e): sentences up to core characters together, with margin sentences of context on both sides.
    Only what begins in the core counts, so neighbours do not report the same twice."""
    from .tagging import chunks

    cores = chunks(sentence_rows, core, doc).select(doc, "chunk", F.col("s").alias("core_s"), F.col("e").alias("core_e"))
    per = sentence_rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_x"))
    d = cores.join(per, doc)
    before = F.slice(F.filter("_x", lambda x: x.e <= F.col("core_s")), -margin, margin) if margin else F.array()
    ahead, after = F.filter("_x", lambda x: x.e <= F.col("core_s")), F.filter("_x", lambda x: x.s >= F.col("core_e"))
    first = F.when(F.size(ahead) > 0, F.element_at(F.slice(ahead, F.greatest(F.size(ahead) - margin + 1, F.lit(1)), margin), 1)["s"]).otherwise(F.col("core_s")) if margin else F.col("core_s")
    last = F.when(F.size(after) > 0, F.element_at(F.slice(after, 1, margin), -1)["e"]).otherwise(F.col("core_e")) if margin else F.col("core_e")
    return d.select(doc, "chunk", first.alias("s"), last.alias("e"), "core_s", "core_e")


def in_core(spans: DataFrame) -> DataFrame:
    """Spans of a chunk (s, e from the chunk's own start; chunk_s, core_s, core_e) as places of the text, if they begin in the core."""
    moved = spans.withColumns({"s": F.col("s") + F.col("chunk_s"), "e": F.col("e") + F.col("chunk_s")})
    return moved.where((F.col("s") >= F.col("core_s")) & (F.col("s") < F.col("core_e")))


def degenerate(spans: DataFrame, chunk_rows: DataFrame, known_labels: tuple[str, ...], share: float = 0.8, doc: str = "doc_id") -> DataFrame:
    """(doc, chunk): chunks whose only span covers most of the core and says nothing: its label is unknown, or it runs over three
    lines. They are to be tagged again line by line."""
    one = spans.groupBy(doc, "chunk").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.max("e").alias("e"), F.first("label").alias("label"), F.first("value").alias("value")).where("n = 1")
    d = one.join(chunk_rows.select(doc, "chunk", "core_s", "core_e"), [doc, "chunk"])
    wide = (F.least("e", "core_e") - F.greatest("s", "core_s")) >= share * (F.col("core_e") - F.col("core_s"))
    return d.where(wide & (~F.col("label").isin(*known_labels) | (F.size(F.split("value", "\n")) >= 3))).select(doc, "chunk")


def lines_to_retry(docs: DataFrame, spans: DataFrame, most_lines: int = 8, most_chars: int = 80, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, s, e): the first short lines that look like a name of two groups and hold nothing but names so far."""
    from ..functions import text as X

    rows = docs.select(F.col(id_column), F.explode(X.spans(text_column, r"[^\n]+")).alias("x")).select(id_column, "x.*")
    rows = rows.where((F.length("value") <= most_chars) & F.col("value").rlike("^[ \t]*[ก-๛]{2,25}[ \t]+[ก-๛]{2,25}[ \t]*$"))
    other = spans.where("data_type <> 'NAME'").select(F.col(id_column).alias("_d"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    free = rows.join(other, (F.col(id_column) == F.col("_d")) & (F.col("_s") < F.col("e")) & (F.col("s") < F.col("_e")), "left_anti")
    first = free.groupBy(id_column).agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "e"))), 1, most_lines).alias("x"))  # lines of one text
    return first.select(id_column, F.explode("x").alias("x")).select(id_column, "x.*")


def vote(token_rows: DataFrame, floors: dict[str, float] | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, i, s, e, tag, prob): of overlapping windows each token keeps the label it was surest of; below a label's floor it is O."""
    best = token_rows.groupBy(doc, "i").agg(F.max(F.struct("prob", "tag", "s", "e")).alias("b")).select(doc, "i", "b.s", "b.e", "b.tag", "b.prob")
    for label, floor in (floors or {}).items():
        best = best.withColumn("tag", F.when(F.col("tag").endswith("-" + label) & (F.col("prob") < floor), "O").otherwise(F.col("tag")))
    return best


def covers_text(tokens: Column, text: Column) -> Column:
    """Whether a tagger's words make up the text, white space aside, and no I- begins without its B- or I-: half answers are none."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    whole = bare(F.array_join(F.transform(tokens, lambda t: t["word"]), "")) == bare(text)
    before = lambda i: F.when(i == 0, F.lit("O")).otherwise(F.element_at(tokens, F.greatest(i, F.lit(1)))["tag"])
    legal = F.forall(F.transform(tokens, lambda t, i: ~t["tag"].startswith("I-") | before(i).isin(F.concat(F.lit("B-"), F.substring(t["tag"], 3, 99)), t["tag"])), lambda ok: ok)
    return whole & legal


def union_route(first: DataFrame, second: DataFrame, route: str | None = None) -> DataFrame:
    """Span rows of two engines together; route: rows of that type come from the second engine alone, all others from the first."""
    if route is None:
        return first.unionByName(second).dropDuplicates()
    return first.where(F.col("data_type") != route).unionByName(second.where(F.col("data_type") == route))
