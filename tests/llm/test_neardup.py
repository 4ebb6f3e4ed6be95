"""The near-duplicate stage against brute force over exact five-word shingle sets."""

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import neardup


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """The ids that stay: the smallest of each component of pairs with a similarity of 0.8 or more."""
    sets = {i: grams(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i for i in sets if up[i] == i}


def made():
    rng = random.Random(3)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 60, 200, 400]))]
        rows.append(" ".join(base))
        for edits in rng.sample(range(1, 14), 4):  # from far above 0.8 to below it
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += ["", None, "  ", "One two", "one  TWO"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk", [512, 2])
def test_stage_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = made()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    want = brute(rows)
    assert len(want) < len(rows) - 40
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == want


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in kept.collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text + " more"
    docs = spark.createDataFrame([(None, text), (None, near), (None, "alone by itself"), (5, "other words that stand here"), (None, "other words that stand here"), (7, None)], "doc_id bigint, text string")
    kept = neardup.keep_one(docs)
    assert kept.where(F.col("doc_id").isNull()).count() == 2
    assert {r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()} == {5, 7}


def test_fingerprints_of_sets():
    from tidemark.llm.simhash import BITS

    hashes = neardup.shingles(" ".join(f"w{i}" for i in range(300)))
    codes = neardup.fingerprints(hashes, 3)
    assert len(set(codes.tolist())) == 3
    salt = 2 * 0x9E3779B97F4A7C15 % 2**64
    counts = [0] * BITS
    for h in hashes.tolist():
        x = h ^ salt
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * by % 2**64
        for b in range(BITS):
            counts[b] += x >> b & 1
    assert int(codes.view("<u8")[1]) == sum(1 << b for b in range(BITS) if 2 * counts[b] > len(hashes))


def test_share_of_missed_pairs_is_what_the_plan_says():
    """Pairs at the threshold itself: the measured share that no band of any fingerprint finds."""
    import numpy as np

    rng, how = np.random.default_rng(5), neardup.plan(10**5)
    missed = 0
    for _ in range(400):
        common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (neardup.fingerprints(np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])), how.tables).view("<u8") for _ in range(2))
        x = a ^ b
        near = (np.bitwise_count(x) <= neardup.DISTANCE) & (np.bitwise_count(np.roll(x, -1)) <= neardup.CHECK)
        band = np.array([[(v >> np.uint64(k * how.width)) & np.uint64((1 << how.width) - 1) == 0 for k in range(how.bands)] for v in x]).any(axis=1)
        missed += not (near & band).any()
    assert missed <= 6  # 2 expected
    assert [neardup.plan(n).width for n in (10, 10**6, 10**8, 10**10)] == [12, 12, 18, 24]


def test_a_large_group_of_near_copies(spark):
    """All near one another in every bucket: the members' tests, not all pairs, and one stays."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((10_000 - i, " ".join(copy)))
    rows += [(20_000 + i, " ".join(f"y{rng.randrange(5000)}" for _ in range(50))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == {8501, *range(20_000, 20_100)}


def test_beyond_the_bound_ids_are_joined_by_shuffle(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == brute(rows)


def test_the_driver_does_not_hold_what_finished_jobs_left(spark):
    """Shuffles whose plans are garbage go as the stage goes on, not when the heap is full."""
    words = [f"word{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[:39] + [f"end{i % 30}"]), "en", "x", 1) for i in range(200)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    shuffles = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    neardup.tidy(spark)
    time.sleep(1)
    before = shuffles.size()
    assert neardup.keep_one(docs).count() == 1
    time.sleep(1)
    assert shuffles.size() - before <= 18
