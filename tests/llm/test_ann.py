import math

import numpy as np
import pytest

from tidewater.llm.ann import nearest


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, name string, v string, shard int, block string").repartition(3)


def brute(rows, every=20, k=20):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, m = [g[0] for g in good], np.array([g[1] for g in good], np.float32).astype(float)
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted((-s, j) for s, j in zip(m @ np.float32(v).astype(float), ids, strict=True) if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [8192, 500])
def test_recall_and_exact_scores(spark, shard_rows):
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.5 * r.normal(size=16)).tolist(), 0, "a", "b", 1, "c") for i in range(3000)]
    want = brute(rows)
    got = {}
    for x in nearest(frame(spark, rows), shard_rows=shard_rows).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert got.keys() == want.keys()
    exact = {q: dict(v) for q, v in brute(rows, k=3000).items()}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - exact[q][j]) < 1e-9 for _, j, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert np.mean([len({j for _, j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_copies_bad_vectors_and_few_rows(spark):
    rows = [(i, [1.0, 0.5], 0, "a", "b", 1, "c") for i in range(30)]
    rows += [(40, [0.5, 1.0], 0, "a", "b", 1, "c"), (60, None, 0, None, None, None, None), (80, [0.0, 0.0], 0, "a", "b", 1, "c"), (100, [float("nan"), 1.0], 0, "a", "b", 1, "c"), (120, [None, 1.0], 0, "a", "b", 1, "c"), (None, [1.0, 1.0], 0, "a", "b", 1, "c"), (140, [], 0, "a", "b", 1, "c"), (40, [0.5, 1.0], 0, "a", "b", 1, "c"), (160, [-0.0, 2.0], 0, "a", "b", 1, "c")]
    got = {}
    for x in nearest(frame(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert got == brute(rows)


def test_empty_table(spark):
    assert nearest(frame(spark, [])).count() == 0
