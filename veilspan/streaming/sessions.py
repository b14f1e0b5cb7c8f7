"""Masking sessions as a stream: tokens that last as long as their session, jobs that run once.

A session keeps its mapping while it is in use and loses it after a time without messages. State lives per key, so a cap on the
number of sessions in the world cannot be kept here; a session's own mapping is as large as the session.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.vocabulary import TOKEN_LABELS
from ..operators.structured import everything

TTL_MS = 30 * 60 * 1000
OUT = "session_id string, message_id long, masked string, tokens int, expired boolean"


def rewritten(text: str, spans: list, session: str, pairs: dict[str, str], numbers: dict[str, int], salt: str = "") -> str:
    """text with a token for each span; pairs (type|original to token) and numbers (values of each type) grow by what is new."""
    letters = hashlib.sha256(f"{salt}|{session}".encode()).hexdigest().translate(str.maketrans("0123456789", "abcdefabcd"))[:25]
    for x in reversed(spans):
        key = f"{x.kind}|{text[x.s : x.e]}"
        if key not in pairs:
            numbers[x.kind] = n = numbers.get(x.kind, 0) + 1
            nonce = hashlib.sha256(f"{salt}|{session}|{key}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:20]
            pairs[key] = f"[{TOKEN_LABELS.get(x.kind, x.kind)}_{letters}_{nonce}_{n}]"
    out, at = [], 0
    for x in spans:
        out += [text[at : x.s], pairs[f"{x.kind}|{text[x.s : x.e]}"]]
        at = x.e
    return "".join(out) + text[at:]


def mask_message(text: str, session: str, pairs: dict[str, str], salt: str = "") -> str:
    """Masked text; pairs (type|original to token) grows by what is new."""
    return rewritten(text, everything(text), session, pairs, dict(Counter(key.split("|", 1)[0] for key in pairs)), salt)


def mask_stream(messages: DataFrame, ttl_ms: int = TTL_MS, salt: str = "") -> DataFrame:
    """(session_id, message_id, masked, tokens, expired) for a stream of (session_id, message_id, text).

    One row for each message, and one with expired set when a session has been idle for ttl_ms and its mapping is gone.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "message_id": [-1], "masked": [None], "tokens": [0], "expired": [True]})
            return
        pairs = json.loads(state.get[0]) if state.exists else {}
        rows = []
        for frame in frames:
            for m in frame.sort_values("message_id").itertuples():
                rows.append((key[0], m.message_id, mask_message(m.text or "", str(key[0]), pairs, salt), len(pairs), False))
        state.update((json.dumps(pairs, ensure_ascii=False),))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(rows, columns=["session_id", "message_id", "masked", "tokens", "expired"])

    return messages.groupBy("session_id").applyInPandasWithState(run, OUT, "pairs string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*columns)), 256))


def dedupe_jobs(jobs: DataFrame, order: str = "seq") -> DataFrame:
    """jobs with verdict: run (the first of its job_id), replay (the same request again), duplicate_conflict (another request)."""
    w = Window.partitionBy("job_id").orderBy(order)
    first = F.first("fingerprint").over(w)
    return jobs.withColumn("verdict", F.when(F.row_number().over(w) == 1, "run").when(F.col("fingerprint") == first, "replay").otherwise("duplicate_conflict"))


def validate_jobs(jobs: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """jobs with error: null where the envelope (contract_version, job_id, operation, payload as JSON) is acceptable."""
    ok_id = F.col("job_id").rlike(r"^[A-Za-z0-9_.:-]{1,128}$")
    return jobs.withColumn(
        "error",
        F.when(F.coalesce("contract_version", F.lit(1)) != 1, "unsupported_version").when(~F.coalesce(ok_id, F.lit(False)), "invalid_job_id")
        .when(~F.coalesce(F.col("operation").isin("sanitize", "roundtrip", "restore", "analyze", "detect"), F.lit(False)), "unknown_operation").when(F.octet_length("payload") > most_bytes, "too_large"),
    )
