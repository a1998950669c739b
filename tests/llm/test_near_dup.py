import itertools
import random
import re

import numpy as np
import pytest

from tests.llm.edge import documents, empty, words
from tidewater.llm import components as stars
from tidewater.llm import near_dup
from tidewater.llm.common import saved
from tidewater.llm.components import components
from tidewater.llm.near_dup import near_duplicates, shingle_sets, superminhash, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {65 + i: 97 + i for i in range(26)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) > n else frozenset([tuple(w)] if w else [])


def expected(rows, n=2):
    sets, parent = [(i, shingles(t, n)) for i, t in rows], {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return sorted((str(i), len(s), str(None if i is None else find(i)), i is None or find(i) == i) for i, s in sets)


def rows_of(frame):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in frame.collect())


def cloud(n, seed):
    """Near copies of a text, many of them further than the threshold from each other."""
    r, base = random.Random(seed), words(80, seed).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"new{r.random()}"
        out.append((1000 * seed + k, " ".join(w), "en", "s", 1))
    return out


def far_cloud(n):
    """Copies of a text with up to twelve words changed, most of them further than the threshold from all others."""
    r, base = random.Random(3), words(150, 9).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"new{r.random()}"
        out.append((k, " ".join(w), "en", "s", 1))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_edge_cases_equal_brute_force(spark, n):
    docs = documents(spark)
    assert rows_of(near_duplicates(docs, words=n)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()], n)


def test_cloud_of_near_copies_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 60)
    monkeypatch.setattr(near_dup, "SET_BLOCK", 16)
    rows = [*cloud(300, 1), *cloud(60, 2), *((5_000_000 + k, words(30, 100 + k), "en", "s", 1) for k in range(50))]
    assert rows_of(near_duplicates(documents(spark, rows), words=2)) == expected([(r[0], r[1]) for r in rows])


def test_short_texts_and_three_word_shingles():
    texts = ["", "a", "A", "a b", "a b c", "a b c d", "a  b\tc d", "c a b c d"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t) for t in texts)])
    for n in (1, 2, 3, 5):
        elements, at = shingle_sets(np.frombuffer(data, np.uint8), bounds, n)
        sets = [frozenset(elements[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
        want = [shingles(t, n) for t in texts]
        assert [len(x) for x in sets] == [len(x) for x in want]
        assert all((len(x & y) == len(u & v)) for x, u in zip(sets, want, strict=True) for y, v in zip(sets, want, strict=True))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 300, np.uint64)
    b = np.concatenate([a[:240], r.integers(0, 1 << 63, 60, np.uint64)])
    sig = superminhash(np.concatenate([a, b, a[:1]]), np.array([0, 300, 600, 601]), 512)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.1
    assert (sig < np.iinfo(np.uint64).max).all()
    assert len(np.unique(sig[2] >> np.uint64(48))) == 512  # one element: its permutation fills every slot in a step of its own


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def test_filter_and_empty_table(spark):
    docs = documents(spark)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and {2, 3, 4} & {r["doc_id"] for r in kept.collect()} == set()
    assert near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize(("few", "levels", "spread", "n"), [(12, 6, 1000, 2), (12, 6, 1000, 5), (4, 2, 1000, 5), (12, 1, 32, 2), (12, 3, 1, 2)])
def test_divided_groups_equal_brute_force(spark, monkeypatch, few, levels, spread, n):
    for name, value in {"FEW": few, "LEVELS": levels, "SPREAD": spread, "PICKS": 8}.items():
        monkeypatch.setattr(near_dup, name, value)
    rows = [*cloud(150, 1), *cloud(60, 2), (1000, words(80, 1) + " more", "en", "s", 1), *((2_000_000 + r[0], f"{r[1]} {words(9, r[0])}", "en", "s", 1) for r in cloud(50, 1))]
    assert rows_of(near_duplicates(documents(spark, rows), words=n)) == expected([(r[0], r[1]) for r in rows], n)


def test_rows_of_blocks_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    met = []

    def counted(df, name):
        out = saved(df, name)
        if name == "blocks":
            met.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "saved", counted)
    monkeypatch.setattr(near_dup, "BLOCK", 32)
    for name, value in {"FEW": 32, "PICKS": 32}.items():
        monkeypatch.setattr(near_dup, name, value, raising=False)
    for n in (300, 1200):
        near_duplicates(documents(spark, far_cloud(n)), words=5)
    assert met[1] < 6 * met[0]


def test_rows_are_joined_once_to_what_blocks_compare(spark, monkeypatch):
    kind, joined = type(spark.range(1)), []
    count = kind.count

    def noted(df):
        joined.append("Join" in df._jdf.queryExecution().optimizedPlan().toString())
        return count(df)

    monkeypatch.setattr(kind, "count", noted)
    docs = documents(spark, cloud(60, 1))
    assert len(rows_of(near_duplicates(docs, words=2))) == 60
    assert joined and not any(joined)


def test_stars_are_components_without_a_step(spark, monkeypatch):
    written = []

    def noted(df, name):
        written.append(name)
        return saved(df, name)

    monkeypatch.setattr(stars, "saved", noted)
    links = spark.createDataFrame([(1, k) for k in range(2, 50)] + [(60, 61), (62, 60), (5, 1), (70, 70)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 50)}, 60: 60, 61: 60, 62: 60}
    assert written == ["links"]
