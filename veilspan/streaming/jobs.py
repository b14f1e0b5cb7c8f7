"""Jobs from a queue, provider calls, and what ends a session."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import settle
from ..operators import matching, risk, structured
from .sessions import dedupe_jobs, fingerprint, mask_message, validate_jobs

OPERATIONS = ("sanitize", "roundtrip", "restore", "analyze", "detect")
BLOCK_ROWS = 250_000  # of events in order that one task takes
TRUSTED = 8  # of its own texts that a session knows again
MOST_CHARS = 200_000
RETRIED = ("timeout", "network", "rate_limited", "server_error")


def within_budget(docs: DataFrame, phases: Column | int = 1, text_column: str = "text", most_chars: int = MOST_CHARS, most_phases: int = 64) -> DataFrame:
    """docs with refused: why a text may not be searched (too long, too many phases), else null."""
    n = F.lit(phases) if isinstance(phases, int) else phases
    return docs.withColumn("refused", F.when(F.length(text_column) > most_chars, "text_too_long").when(n > most_phases, "too_many_phases"))


def run_jobs(jobs: DataFrame, salt: str = "") -> DataFrame:
    """(job_id, seq, verdict, result, error) of envelopes (contract_version, job_id, seq, operation, payload: JSON with text and pairs).

    Bad envelopes and texts over the budget are told in error and never raise; of a job_id the first runs, the same request again gets
    the same result, another one is a conflict. Results are JSON. Rows of a batch do not depend on one another.
    """
    d = fingerprint(validate_jobs(jobs), ["operation", "payload"])
    good = dedupe_jobs(d.where("error IS NULL"), "seq").unionByName(d.where("error IS NOT NULL").withColumn("verdict", F.lit("rejected")))
    good = good.withColumn("_text", F.get_json_object("payload", "$.text"))
    good = good.withColumn("error", F.coalesce("error", F.when(F.col("verdict") == "duplicate_conflict", "duplicate_conflict").when(F.col("_text").isNull(), "invalid_payload").when(F.length("_text") > MOST_CHARS, "text_too_long")))

    @F.pandas_udf("result string, error string")
    def work(operation: pd.Series, job: pd.Series, text: pd.Series, payload: pd.Series) -> pd.DataFrame:
        import json

        def one(op, job_id, t, body):
            pairs: dict[str, str] = {}
            if op in ("sanitize", "roundtrip"):
                masked = mask_message(t, job_id, pairs, salt)
                if op == "roundtrip":
                    masked = matching.rewrite(masked, {v: k.split("|", 1)[1] for k, v in pairs.items()})
                return {"text": masked, "entities": len(pairs)}
            if op == "restore":
                known = json.loads(body).get("pairs") or {}
                if not all(isinstance(x, str) for kv in known.items() for x in kv):
                    raise ValueError("pairs are texts")
                return {"text": matching.rewrite(t, known)}
            found = structured.everything(t)
            if op == "detect":
                return {"spans": [[x.s, x.e, x.kind] for x in found]}
            return {"types": dict(Counter(x.kind for x in found))}

        out = []
        for row in zip(operation, job, text, payload):
            try:
                out.append((json.dumps(one(*row), ensure_ascii=False), None))
            except (ValueError, AttributeError):  # of the payload: its pairs are no mapping of texts
                out.append((None, "invalid_payload"))
        return pd.DataFrame(out, columns=["result", "error"])

    run = F.col("error").isNull()
    done = good.withColumn("_done", F.when(run, work("operation", "job_id", F.when(run, F.col("_text")).otherwise(F.lit("")), "payload")))
    return done.select("job_id", "seq", "verdict", F.col("_done.result").alias("result"), F.coalesce("error", F.col("_done.error")).alias("error"))


def work_queue(incoming: DataFrame, submit: Callable[[DataFrame, int], None], checkpoint: str, salt: str = ""):
    """A streaming writer that polls a queue of envelopes, runs each batch and submits its results under the batch's number, so that a
    batch that is delivered again overwrites itself."""
    return incoming.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: submit(run_jobs(batch, salt), number))


def call_provider(rows: DataFrame, call: Callable[[str], tuple[str | None, str | None]], attempts: int = 3, wait: float = 1.0, text_column: str = "text", id_column: str = "doc_id", guard: Callable[[str], bool] | None = None) -> DataFrame:
    """(id, reply, attempts, error): a provider is asked up to so many times, with a growing pause; only failures that may pass are
    tried again, and each attempt must pass the guard."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame[id_column], frame[text_column]):
                reply, error, n = None, None, 0
                while n < attempts:
                    if guard and not guard(text):
                        error = "blocked"
                        break
                    n += 1
                    reply, error = call(text)
                    if error not in RETRIED or n == attempts:
                        break
                    time.sleep(wait * n)
                out.append((key, reply, n, error))
            yield pd.DataFrame(out, columns=[id_column, "reply", "attempts", "error"])

    return rows.select(id_column, text_column).mapInPandas(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, reply string, attempts int, error string")


def trusted_digests(sent: DataFrame, session: str = "session_id", order: str = "seq", digest: str = "digest", keep: int = TRUSTED) -> DataFrame:
    """(session, digests): of its masked texts the last few; a reply to one of them need not be checked for new data again."""
    last = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return sent.withColumn("_r", last).where(F.col("_r") <= keep).groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest]).alias("digests"))


def lifecycle(events: DataFrame, ttl: float = 1800.0, session: str = "session_id") -> DataFrame:
    """events (session, at, seq, kind: use or close, mode) with state: created, active, recreated (after it had expired), closed,
    already_closed, wrong_mode. A session locks the mode of its first use, ends after ttl seconds without use or when it is closed,
    and what comes after is a new session. Closing twice changes nothing.

    A session may hold most events: rows are dealt to blocks by (session, at, seq), windows run within a session's block, and what goes
    on over a border (the last row, the open life's mode and whether it was closed) is carried over from summaries of the blocks.
    """
    blocks = max(1, -(-events.count() // BLOCK_ROWS))
    e = settle(events.repartitionByRange(blocks, session, "at", "seq").withColumn("_b", F.spark_partition_id()))
    own, before = [session, "_b"], Window.partitionBy(session).orderBy("_b")

    def with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
        names = {session: "_session", "_b": "_block"}
        c = carried.withColumnsRenamed(names)
        return rows.join(c, rows[session].eqNullSafe(c["_session"]) & (rows["_b"] == c["_block"])).drop(*names.values())

    last = e.groupBy(own).agg(F.max(F.struct("at", "seq", "kind")).alias("_x")).select(*own, F.lag("_x").over(before).alias("_last"))
    w = Window.partitionBy(own).orderBy("at", "seq")
    first = F.row_number().over(w) == 1
    previous = lambda c: F.when(first, F.col(f"_last.{c}")).otherwise(F.lag(c).over(w))
    d = with_carried(e, last).withColumns({"_gap": F.col("at") - previous("at"), "_kind": previous("kind"), "_first": first & F.col("_last").isNull()}).drop("_last")
    d = d.withColumn("_new", F.when(F.col("_gap").isNull() | (F.col("_gap") > ttl) | ((F.col("_kind") == "close") & (F.col("kind") == "use")), 1).otherwise(0))
    d = d.withColumn("_life", F.sum("_new").over(w))  # 0: the life that the block before left open
    closes = F.max(F.coalesce((F.col("kind") == "close").cast("int"), F.lit(0)))
    lives = d.groupBy(*own, "_life").agg(F.min_by(F.struct("mode"), F.struct("at", "seq")).alias("_mode"), closes.alias("_closed"))
    ends = lives.groupBy(own).agg(F.max_by(F.struct("_life", "_mode", "_closed"), "_life").alias("_x")).select(*own, "_x.*")
    ends = ends.withColumn("_open", F.sum((F.col("_life") > 0).cast("int")).over(before))
    since = Window.partitionBy(session, "_open").orderBy("_b")
    ends = ends.withColumn("_x", F.struct(F.first("_mode").over(since).alias("mode"), F.max("_closed").over(since).alias("closed")))
    d = with_carried(d, ends.select(*own, F.lag("_x").over(before).alias("_carried")))
    life = Window.partitionBy(*own, "_life").orderBy("at", "seq")
    goes_on = F.col("_life") == 0
    mode = F.when(goes_on, F.col("_carried.mode.mode")).otherwise(F.first("mode").over(life))
    closed = F.coalesce(F.max(F.when(F.col("kind") == "close", 1)).over(life.rowsBetween(Window.unboundedPreceding, -1)), F.when(goes_on, F.col("_carried.closed")), F.lit(0))
    state = (
        F.when(F.col("kind") == "close", F.when((closed == 1) | (F.col("_new") == 1), "already_closed").otherwise("closed"))
        .when(F.col("_new") == 1, F.when(F.col("_first"), "created").otherwise("recreated")).when(F.col("mode") != mode, "wrong_mode").otherwise("active")
    )
    return d.select(*events.columns, state.alias("state"))


def report(docs: DataFrame) -> DataFrame:
    """The whole analysis of documents, as the analyze operation gives it: spans, risk, categories and grade."""
    return risk.report(structured.detect(docs))
