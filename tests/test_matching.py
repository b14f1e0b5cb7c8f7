"""Known values in texts against a plain search; surrogates that would stand in a text already; jobs that restore."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from veilspan.operators import masking, matching, restoring
from veilspan.streaming import jobs

TEXTS, PAIRS = "doc_id long, session_id string, text string", "session_id string, pseudonym string, original string"
SPANS = "session_id string, doc_id int, s int, data_type string, value string"


def plain(texts, pairs, guarded):
    out = {}
    for doc, session, text in texts:
        found = []
        for own, p, o in pairs:
            if own is not None and own == session and p and text:
                found += [(i, i + len(p), p, o) for i in range(len(text) - len(p) + 1) if text.startswith(p, i) and (not guarded or matching.stands_alone(text, i, i + len(p)))]
        kept = []
        for x in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        if kept:
            out[doc] = sorted(kept)
    return out


@pytest.mark.parametrize("guarded", [True, False])
@pytest.mark.parametrize("limits", [None, (40, 300, 500)])
def test_equals_plain_search(spark, guarded, limits):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab01ก😀 ") for _ in range(n))
    pairs = {(rng.choice(["x", "y", "z", None]), word(rng.randint(1, 4))): f"o{i}" for i in range(60)}
    pairs = [(s, p, o) for (s, p), o in pairs.items()] + [("x", "", "nothing")]
    texts = [(i, rng.choice(["x", "x", "y", "w", None]), rng.choice([word(rng.randint(0, 60)), None])) for i in range(120)]
    args = (spark.createDataFrame(texts, TEXTS).repartition(4), spark.createDataFrame(pairs, PAIRS), "session_id", "text", "doc_id", "pseudonym", "original", guarded)
    got = matching.find(*args, **({"limits": limits} if limits else {})).collect()
    assert {r.doc_id: [tuple(x) for x in r.found] for r in got} == plain(texts, pairs, guarded)


def test_values_with_one_prefix_take_time_in_proportion(spark):
    rng = random.Random(12)
    pairs = [("s", f"081{i:07d}", str(i)) for i in range(3_000)]
    texts = [(d, "s", " ".join(f"081{rng.randrange(6_000):07d}" for _ in range(1_500))) for d in range(8)]
    t, p = spark.createDataFrame(texts, TEXTS), spark.createDataFrame(pairs, PAIRS)
    began = time.perf_counter()
    got = {r.doc_id: len(r.found) for r in restoring.occurrences(t, p).collect()}
    assert time.perf_counter() - began < 20
    assert got == {d: sum(int(w[3:]) < 3_000 for w in text.split()) for d, _, text in texts}


def test_a_pseudonym_of_two_originals_is_an_error(spark):
    pairs = spark.createDataFrame([("s", "x1", "a"), ("s", "x1", "b")], PAIRS)
    with pytest.raises(Exception, match="two originals"):
        restoring.occurrences(spark.createDataFrame([(1, "s", "x1")], TEXTS), pairs).collect()


def test_occurring_finds_parts_too(spark):
    t = spark.createDataFrame([(1, "s", "508111111112"), (2, "t", "x")], TEXTS)
    p = spark.createDataFrame([("s", "0811111111", ""), ("s", "99", ""), ("t", "0811111111", "")], PAIRS)
    assert [tuple(r) for r in matching.occurring(t, p, "session_id", "text", "pseudonym").collect()] == [("s", "0811111111")]


def test_surrogates_never_stand_in_a_text(spark):
    """Each value's first draws are planted: as they are, folded, or within a longer run."""
    spans = spark.createDataFrame([("s", i, 0, "PHONE", f"08{i:08d}") for i in range(20)] + [("s", 0, 0, "NAME", "มานี ใจดี"), ("t", 1, 0, "PHONE", "0800000001")], SPANS)
    first = {(r.session_id, r.original): r.pseudonym for r in masking.surrogates(spans).collect()}
    planted = [v for i, v in enumerate(first.values())]
    texts = [(i, "s", ("see {} now", "see {}", "x7{}7x")[i % 3].format(v if i % 3 != 1 else "-".join(v))) for i, v in enumerate(planted)]
    made = masking.assign(spans, texts=spark.createDataFrame(texts, TEXTS)).collect()
    fold = lambda v: "".join(c for c in v.casefold() if c.isalnum() or "ั" <= c <= "๎")
    own = [r for r in made if r.session_id == "s"]
    assert len(own) == 21 and not any(r.pseudonym in t or fold(r.pseudonym) in fold(t) for r in own for _, _, t in texts)
    other = [r for r in made if r.session_id == "t"]
    assert [r.pseudonym for r in other] == [first["t", "0800000001"]]  # its session's texts do not show it


def test_prior_pairs_are_kept_only_where_they_hide(spark):
    spans = spark.createDataFrame([("s", 1, 0, "PHONE", "0811111111"), ("s", 2, 0, "PHONE", "0822222222"), ("s", 3, 0, "PHONE", "+66 83 333 3333"), ("s", 4, 0, "EMAIL", "a@b.co")], SPANS)
    prior = spark.createDataFrame([("s", "[p_1]", "0811111111"), ("s", "in text", "0822222222"), ("s", "0833333333", "+66 83 333 3333"), ("s", "free", "a@b.co")], PAIRS)
    texts = spark.createDataFrame([(1, "s", "it is IN-TEXT here")], TEXTS)
    made = {r.original: (r.pseudonym, r.seeded) for r in masking.assign(spans, prior=prior, texts=texts).collect()}
    assert made["0811111111"] == ("[p_1]", True) and made["a@b.co"] == ("free", True)
    assert not made["0822222222"][1] and not made["+66 83 333 3333"][1]


def test_names_beyond_the_pool_get_numbers(spark):
    spans = spark.createDataFrame([("s", i, 0, "SURNAME", f"สกุล{i}") for i in range(60)], SPANS)
    made = [r.pseudonym for r in masking.assign(spans).collect()]
    assert len(set(made)) == 60 and sum("#" in p for p in made) >= 60 - len(masking.FAMILY)


@pytest.mark.parametrize("text,pairs,want", [
    ("ref 508111111112 end 0811111111", {"0811111111": "0899999999"}, "ref 508111111112 end 0899999999"), ("a b", {"a": "b", "b": "a"}, "b a"), ("[x_1][x_10]", {"[x_1]": "one", "[x_10]": "ten"}, "oneten"), ("t", {}, "t"),
])
def test_jobs_restore_in_one_guarded_pass(spark, text, pairs, want):
    payload = json.dumps({"text": text, "pairs": pairs})
    d = spark.createDataFrame([(1, "j", 1, "restore", payload), (1, "k", 2, "restore", json.dumps({"text": "t", "pairs": {"a": 1}})), (1, "l", 3, "roundtrip", json.dumps({"text": "โทร 0812345678 ครับ"}))], "contract_version int, job_id string, seq long, operation string, payload string")
    got = {r.job_id: r for r in jobs.run_jobs(d).collect()}
    assert json.loads(got["j"].result)["text"] == want and got["k"].error == "invalid_payload" and got["k"].result is None
    assert json.loads(got["l"].result) == {"text": "โทร 0812345678 ครับ", "entities": 1}
