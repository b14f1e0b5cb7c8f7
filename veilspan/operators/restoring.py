"""Restoring any kind of pseudonym, and what is checked before a restored text leaves.

Tokens are brackets and are found by one pattern (masking.restore). Surrogates look like ordinary words and numbers: all of a session are
looked for at once (matching).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.layout import looked_up, merged
from ..functions.vocabulary import TOKEN_LABELS
from . import matching

MOST_TOKEN = 130  # characters of a token


# --- tokens -----------------------------------------------------------------------------------------------------------------------
_TOKEN = r"^\[([^\[\]\r\n]+)_([a-f]{25})_([a-z]{20})_([1-9][0-9]*)\]$"


def token_parts(candidate: str | Column) -> Column:
    """struct<label,namespace,nonce,ordinal> of a token of this library's grammar; null for anything else."""
    c = F.col(candidate) if isinstance(candidate, str) else candidate
    part = lambda i: F.regexp_extract(c, _TOKEN, i)
    good = (F.length(c) <= MOST_TOKEN) & c.rlike(_TOKEN)
    return F.when(good, F.struct(part(1).alias("label"), part(2).alias("namespace"), part(3).alias("nonce"), part(4).cast("long").alias("ordinal")))


def token_type(candidate: str | Column) -> Column:
    """The data type that a token's label names; null if there is none."""
    known = F.create_map(*[F.lit(x) for k, v in TOKEN_LABELS.items() for x in (v, k)])
    return F.element_at(known, token_parts(candidate)["label"])


def is_token_of(candidate: str | Column, data_type: str | Column, legacy: bool = False) -> Column:
    """Whether a token has the label of a type; legacy: [label_N] counts too."""
    c = F.col(candidate) if isinstance(candidate, str) else candidate
    kind = F.col(data_type) if isinstance(data_type, str) else data_type
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TOKEN_LABELS.items() for x in kv]), kind), kind)
    own = F.coalesce(token_parts(c)["label"] == label, F.lit(False))
    if not legacy:
        return own
    rest = F.substring(c, F.length(label) + 3, F.length(c))
    return own | ((F.length(c) <= MOST_TOKEN) & c.startswith(F.concat(F.lit("["), label, F.lit("_"))) & rest.rlike(r"^[1-9][0-9]*\]$"))


# --- finding pseudonyms -----------------------------------------------------------------------------------------------------------
def occurrences(texts: DataFrame, pairs: DataFrame, session: str = "session_id", text_column: str = "text", id_column: str = "doc_id", guarded: bool = True) -> DataFrame:
    """(id, found): where a session's pseudonyms stand in its texts, array<struct<s,e,pseudonym,original>> by start: longest first,
    without overlaps; guarded: none that is part of a longer number or word. A pseudonym that stands for two originals is an error."""
    found = matching.find(texts, pairs, session, text_column, id_column, "pseudonym", "original", guarded)
    return found.select(id_column, F.transform("found", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.pattern.alias("pseudonym"), x.value.alias("original"))).alias("found"))


def restore_all(replies: DataFrame, pairs: DataFrame, session: str = "session_id", text_column: str = "masked", id_column: str = "doc_id") -> DataFrame:
    """(id, session, restored, restored_ranges, replaced, missing, residue) of replies that hold tokens or surrogates.

    restored_ranges: where originals stand in the restored text. missing: how many of the session's pseudonyms the reply lacks;
    residue: how many are still in the restored text.
    """
    base = replies.select(id_column, session, F.coalesce(F.col(text_column), F.lit("")).alias("_reply"))
    d = base.join(merged(occurrences(base, pairs, session, "_reply", id_column)), id_column, "left")
    none = F.coalesce(F.size("found"), F.lit(0)) <= 0
    restored = F.when(none, F.col("_reply")).otherwise(X.rebuild(F.col("_reply"), F.col("found"), lambda x: x.original))
    ranges = F.aggregate(
        "found", F.struct(F.lit(0).alias("by"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda a, x: F.struct((a.by + F.length(x.original) - (x.e - x.s)).alias("by"), F.concat(a.out, F.array(F.struct((x.s + a.by).cast("int").alias("s"), (x.s + a.by + F.length(x.original)).cast("int").alias("e")))).alias("out")),
        lambda a: a.out,
    )
    d = d.select(id_column, session, restored.alias("restored"), F.when(none, F.array().cast("array<struct<s:int,e:int>>")).otherwise(ranges).alias("restored_ranges"), F.coalesce(F.size("found"), F.lit(0)).alias("_k"), F.when(none, F.lit(0)).otherwise(F.size(F.array_distinct(F.transform("found", lambda x: x.pseudonym)))).alias("_used"))
    left = occurrences(d.select(id_column, session, F.col("restored").alias("_reply")), pairs, session, "_reply", id_column, guarded=False).select(id_column, F.size("found").alias("_left"))
    owned = pairs.groupBy(session).agg(F.countDistinct("pseudonym").alias("_owned"))
    d = d.join(merged(left), id_column, "left").join(looked_up(owned), session, "left")
    return d.select(id_column, session, "restored", "restored_ranges", F.greatest("_k", F.lit(0)).cast("long").alias("replaced"), (F.coalesce("_owned", F.lit(0)) - F.col("_used")).cast("long").alias("missing"), F.coalesce("_left", F.lit(0)).cast("long").alias("residue"))


# --- validation -------------------------------------------------------------------------------------------------------------------
ENDINGS = r"[\p{L}\p{M}\p{N}.!?ฯๆ…%)\]}»\"'”’]$"  # what a finished text may end in, besides white space


def integrity_flags(text: Column) -> Column:
    """Flags of a text that was cut off: long, and its last character is none that ends a text."""
    cut = (F.length(text) > 20) & ~F.substring(text, F.length(text), F.lit(1)).rlike(ENDINGS) & ~F.substring(text, F.length(text), F.lit(1)).rlike(r"(?U)\s$")
    return F.when(cut, F.array(F.lit("possible_truncation:no_terminal_punctuation"))).otherwise(F.array().cast("array<string>"))


def completeness_flags(residue: Column, total: Column, replaced: Column) -> Column:
    """Flags of pseudonyms that stay in the text and of originals that did not come back; these never stop a text."""
    return F.filter(
        F.array(
            F.when(residue > 0, F.concat(F.lit("pseudonym_residue:"), residue.cast("string"))),
            F.when((total > 0) & (replaced < total), F.concat(F.lit("incomplete_reverse:"), replaced.cast("string"), F.lit("/"), total.cast("string"))),
        ),
        lambda x: x.isNotNull(),
    )


def validate(restored: DataFrame, found: DataFrame, originals: DataFrame, session: str = "session_id", id_column: str = "doc_id") -> DataFrame:
    """(id, decision, flags, text) of restored texts: personal data is expected only within a range that restoring wrote and whose
    text is an original of the session. Anything else that a detector finds (found: id, s, e) blocks the text; only its count is told.

    restored: as from restore_all. The text is null where blocked or cut off.
    """
    ranges = restored.select(id_column, session, F.explode("restored_ranges").alias("r"), "restored").select(id_column, session, "r.s", "r.e", F.substring(F.col("restored"), F.col("r.s") + 1, F.col("r.e") - F.col("r.s")).alias("original"))
    sure = ranges.join(merged(originals.select(session, "original").distinct()), [session, "original"], "left_semi").groupBy(id_column).agg(F.collect_list(F.struct("s", "e")).alias("_sure"))
    spans = found.groupBy(id_column).agg(F.collect_list(F.struct("s", "e")).alias("_found"))
    d = restored.join(merged(sure), id_column, "left").join(merged(spans), id_column, "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    ok = F.coalesce(F.col("_sure"), none)
    odd = F.size(F.filter(F.coalesce(F.col("_found"), none), lambda x: ~F.exists(ok, lambda r: (r.s <= x.s) & (x.e <= r.e))))
    soft = completeness_flags(F.col("residue"), F.col("replaced") + F.col("missing"), F.col("replaced"))
    hard = F.concat(F.when(odd > 0, F.array(F.concat(F.lit("unexpected_pii_count:"), odd.cast("string")))).otherwise(F.array().cast("array<string>")), integrity_flags(F.col("restored")))
    passed = F.size(hard) == 0
    return d.select(id_column, F.when(odd > 0, "leak").when(passed, "pass").otherwise("halt").alias("decision"), F.concat(hard, soft).alias("flags"), F.when(passed, F.col("restored")).alias("text"))
