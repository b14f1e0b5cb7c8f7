"""Masking sessions with a state for each value, a locked mode, expiry, disposal and tombstones.

A session is one key of transformWithState: its originals are entries of a map, so a message reads and writes only the values that it
holds, however large the session is. A message is published as a whole or not at all: its masked text is complete before the first
entry is written, and a micro-batch that fails runs again from the state before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.structured import everything
from .jobs import TRUSTED
from .sessions import TTL_MS, rewritten

TOMBSTONE_MS = 24 * 60 * 60 * 1000  # how long a session that is gone is told from one that never was
CAP = 200  # sessions that live at a time
MODES = ("token",)
OUT = "session_id string, message_id long, outcome string, masked string, new_values int"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class Sessions(StatefulProcessor):
    """The states of a session: session (its mode and when it ends), tokens (type|original to token), counts (values of a type),
    recent (digests of the last texts that it masked), gone (why it ended, and until when that is remembered)."""

    def __init__(self, ttl_ms: int, tombstone_ms: int, salt: str):
        self.ttl_ms, self.tombstone_ms, self.salt = ttl_ms, tombstone_ms, salt

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "mode string, ends long")
        self.tokens = handle.getMapState("tokens", "value string", "token string")
        self.counts = handle.getMapState("counts", "kind string", "n int")
        self.recent = handle.getListState("recent", "digest string")
        self.gone = handle.getValueState("gone", "reason string, ends long")

    def _rest(self, ends: int) -> None:
        """One timer for a session: its end, or the end of its tombstone."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ends)

    def _drop(self, reason: str, now: int) -> None:
        for state in (self.session, self.tokens, self.counts, self.recent):
            state.clear()
        self.gone.update((reason, now + self.tombstone_ms))
        self._rest(now + self.tombstone_ms)

    def _mask(self, session: str, text: str) -> tuple[str, int]:
        """Masked text and how many values are new; states change only when the text is done."""
        spans = everything(text)
        pairs, numbers = {}, {}
        for x in spans:
            key = f"{x.kind}|{text[x.s : x.e]}"
            if key not in pairs and (known := self.tokens.getValue((key,))) is not None:
                pairs[key] = known[0]
            if x.kind not in numbers:
                n = self.counts.getValue((x.kind,))
                numbers[x.kind] = n[0] if n else 0
        old, before = set(pairs), dict(numbers)
        masked = rewritten(text, spans, session, pairs, numbers, self.salt)
        for key in pairs.keys() - old:
            self.tokens.updateValue((key,), (pairs[key],))
        for kind, n in numbers.items():
            if n != before[kind]:
                self.counts.updateValue((kind,), (n,))
        self.recent.put([*[d for d in self.recent.get() if d][1 - TRUSTED :], (digest(masked),)])
        return masked, len(pairs) - len(old)

    def _one(self, session: str, kind: str, mode: str | None, text: str | None, now: int) -> tuple[str, str | None, int]:
        if self.session.exists() and self.session.get()[1] <= now:  # due, and its timer has not run yet
            self._drop("expired", now)
        if self.gone.exists() and self.gone.get()[1] <= now:
            self.gone.clear()
        alive = self.session.exists()
        if kind in ("close", "dispose"):
            if not alive:
                return ("already_gone" if self.gone.exists() else "unknown"), None, 0
            self._drop("closed" if kind == "close" else "disposed", now)
            return self.gone.get()[0], None, 0
        if kind == "trust":
            return ("trusted" if alive and (digest(text or ""),) in [tuple(d) for d in self.recent.get()] else "not_trusted"), None, 0
        if kind != "mask":
            return "unknown_kind", None, 0
        if not alive and self.gone.exists():
            return "session_gone", None, 0
        held = self.session.get()[0] if alive else None
        wanted = mode or held or MODES[0]
        if wanted not in MODES:
            return "unknown_mode" if not alive else "wrong_mode", None, 0
        if held and wanted != held:
            return "wrong_mode", None, 0
        masked, new = self._mask(session, text or "")
        self.session.update((wanted, now + self.ttl_ms))
        self._rest(now + self.ttl_ms)
        return "masked", masked, new

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        messages = pd.concat(list(rows)).sort_values("message_id", kind="stable")
        tell = lambda v: None if pd.isna(v) else v
        out = [(str(key[0]), m.message_id, *self._one(str(key[0]), m.kind, tell(m.mode), tell(m.text), now)) for m in messages.itertuples()]
        yield pd.DataFrame([(s, i, o, t, n) for s, i, o, t, n in out], columns=["session_id", "message_id", "outcome", "masked", "new_values"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.session.exists():
            self._drop("expired", now)
            yield pd.DataFrame([(str(key[0]), -1, "expired", None, 0)], columns=["session_id", "message_id", "outcome", "masked", "new_values"])
        elif self.gone.exists():
            self.gone.clear()

    def close(self) -> None:
        pass


def session_stream(messages: DataFrame, ttl_ms: int = TTL_MS, tombstone_ms: int = TOMBSTONE_MS, salt: str = "") -> DataFrame:
    """(session_id, message_id, outcome, masked, new_values) of a stream of (session_id, message_id, kind, mode, text).

    kind mask: the first use creates the session and locks its mode; outcome masked, wrong_mode, unknown_mode (neither changes
    anything), or session_gone while a tombstone is kept. Kinds close and dispose end a session: closed or disposed the first time,
    already_gone after that, unknown where there never was one. Kind trust asks whether text is one of the last texts that the session
    masked. Others are unknown_kind. A session that has masked nothing for ttl_ms gives a row expired, with message_id -1. Null texts
    are empty, a null mode is the session's. Needs the RocksDB state store.
    """
    wanted = messages.select(F.col("session_id").cast("string").alias("session_id"), F.col("message_id").cast("long").alias("message_id"), "kind", "mode", "text")
    return wanted.groupBy("session_id").transformWithStateInPandas(Sessions(ttl_ms, tombstone_ms, salt), OUT, "append", "processingTime")


def least_recent(uses: DataFrame, cap: int = CAP) -> DataFrame:
    """(session_id, last_use) of the sessions that must go so that cap remain: those whose last use (at) is longest ago, ties by id.

    uses: (session_id, at) with as many rows for a session as it was used. The cut is found among the cap most recent sessions, which
    a sort with a limit gathers from each task's own; the others are told by comparing with it, without a window over all sessions.
    """
    last = uses.where(F.col("session_id").isNotNull() & F.col("at").isNotNull()).groupBy("session_id").agg(F.max("at").alias("last_use"))
    kept = last.orderBy(F.desc("last_use"), F.desc("session_id")).limit(cap)
    cut = kept.agg(F.min(F.struct("last_use", "session_id")).alias("_cut"), F.count("*").alias("_n"))
    return last.crossJoin(F.broadcast(cut)).where((F.col("_n") == cap) & (F.struct("last_use", "session_id") < F.col("_cut"))).select("session_id", "last_use")


def evict(uses: DataFrame, cap: int = CAP) -> DataFrame:
    """Messages for session_stream that dispose of the sessions beyond cap; message_id is below all of the session's own."""
    return least_recent(uses, cap).select("session_id", F.lit(-2).cast("long").alias("message_id"), F.lit("dispose").alias("kind"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("text"))
