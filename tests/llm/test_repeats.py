import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import documents, empty, words
from tidewater.llm import repeats
from tidewater.llm.repeats import repeated_places, repeats_digest, segments, without_repeats


def expected(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return out


def rows_of(frame):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect())


def check(spark, docs, length=200, gram=80):
    rows = docs.collect()
    want = sorted((str(r["doc_id"]), *e) for r, e in zip(rows, expected([r["text"] for r in rows], length), strict=True))
    got = without_repeats(docs, length, gram).withColumn("kept_sha256", F.sha2("kept", 256)) if (length, gram) != (200, 80) else repeats_digest(docs)
    assert rows_of(got) == want
    return want


def test_edge_cases_equal_brute_force(spark):
    assert any(w[2] for w in check(spark, documents(spark)))


@pytest.mark.parametrize("largest", [1, 5])
def test_passage_in_many_contexts_equals_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(repeats, "LARGEST", largest)  # runs grow, some of them till they are whole strings
    passages = [words(n, 50 + n) for n in (20, 30, 45, 60)]
    rows = [(k, f"{words(20, 1000 + k)} {passages[k % 4]} {passages[(k // 4) % 4]} {words(15, 2000 + k % 7)}", "en", "s", 1) for k in range(60)]
    check(spark, documents(spark, rows))


@pytest.mark.parametrize(("length", "gram"), [(400, 80), (90, 80), (80, 80), (700, 30)])
def test_other_lengths_equal_brute_force(spark, length, gram):
    passages = [words(n, 50 + n) for n in (15, 40, 90, 200)]
    rows = [(k, f"{words(20, 1000 + k)} {passages[k % 4]} {passages[(k // 4) % 4]} {words(15, 2000 + k % 7)}", "en", "s", 1) for k in range(24)]
    assert any(w[2] for w in check(spark, documents(spark, rows), length, gram))


def test_large_ids_and_nulls_stay(spark):
    docs = spark.createDataFrame([(2**62 + 1, "x"), (None, "y")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in repeats_digest(docs).collect()} == {2**62 + 1, None}
    with pytest.raises(ValueError):
        repeats_digest_of_length(docs, 79)


def repeats_digest_of_length(docs, length):
    return without_repeats(docs, length).collect()


def test_rounds_equal_comparison():
    r = np.random.default_rng(3)
    run = bytes(r.integers(97, 99, 8).astype(np.uint8))
    strings = [bytes(r.integers(97, 99, 12).astype(np.uint8)) + run + bytes(r.integers(97, 99, 12).astype(np.uint8)) for _ in range(60)]
    found = repeated_places(strings, np.full(60, 12), 20, 8)
    count = Counter((k, s[k : k + 20]) for s in strings for k in range(13))
    assert [[count[k, s[k : k + 20]] > 1 for k in range(13)] for s in strings] == found.tolist()


def test_equal_strings_are_filed_alike():
    text = words(400, 9).encode()
    twice = text + b"|" + text
    first, second = (segments(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in (text, twice))
    keys = set(first[4].tolist())
    assert keys <= set(second[4].tolist())
    assert sum(second[2].tolist()) == len(twice) - 199


def test_empty_table(spark):
    assert repeats_digest(empty(spark)).count() == 0
