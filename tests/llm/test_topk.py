"""Exact top-k search against a plain scan of all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from docketry.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score double, rank int, h1 long, block long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 3, 4, 5) for i, v in rows], SCHEMA)


def plain(rows, k, scale=64):
    """All pairs, in memory: zeros stand for missing places, repeated rows count once."""
    good = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if (i, y) != (q, x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def cloud(seed, n, dim, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [c + spread * rng.gauss(0, 1) for c in centres[i % 4]]) for i in range(n)]


CASES = {
    "clusters": cloud(1, 300, 8, 0.05),
    "noise": cloud(2, 200, 16),
    "a third alike": [(i, [1.0, 0.5, -2.0] if i % 3 else [i / 100, -1.0, 2.0]) for i in range(240)],
    "all alike": [(i, [0.25, 0.5]) for i in range(60)],
    "odd rows": cloud(3, 60, 3) + [(None, [1.0, 1.0, 1.0]), (61, None), (62, [1.0, None, 2.0]), (80, [float("nan"), 1.0, 1.0]), (100, [float("inf"), 0.0, 0.0]), (120, []), (63, [4.0]), (140, [0.0, 0.0, 0.0, 9.0])],
    "repeats": cloud(4, 50, 3) + cloud(4, 50, 3) + [(20, [5.0, 5.0, 5.0]), (20, [5.0, 5.0, 5.0]), (2**60, [4.0, 4.0, 4.0]), (2**60 + 20 - 2**60 % 20, [3.0, 4.0, 4.0])],
    "few": [(0, [1.0]), (20, [2.0]), (21, [-1.0])],
    "one": [(0, [1.0, 2.0])],
    "large numbers": [(i, [2.0**20 * (i + 1), -(2.0**21), 3.0]) for i in range(45)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_all_pairs(spark, case):
    out = topk.top_k(frame(spark, CASES[case]), lambda i: i % 20 == 0, k=5, pivots=4, sample=40, rings=16, block_rows=16, first=20, growth=2)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert found(out) == plain(CASES[case], 5)


def test_no_rows(spark):
    assert topk.top_k(frame(spark, []), lambda i: i % 20 == 0).collect() == []
    assert topk.top_k(frame(spark, [(1, [1.0])]), lambda i: i % 20 == 0).collect() == []


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(5)
    v = np.floor(64 * np.concatenate([rng.normal(c, 0.02, (50, 6)) for c in np.eye(6)])).astype(np.int64)
    reach = float(np.sqrt((v * v).sum(axis=1).max()))
    x = topk.lifted(v, reach)
    pivots = topk.far_pivots(x, 6)
    distance = np.sqrt(((x[:, None] - pivots) ** 2).sum(axis=2))
    nearest = distance.argmin(axis=1)
    low, high = (np.array([f(distance[nearest == p, p]) for p in range(6)]) for f in (np.min, np.max))
    d = topk.Directory(pivots, reach, np.arange(6), low - 1e-6, high + 1e-6, np.bincount(nearest), np.arange(6), np.ones(6))
    bounds, scores = topk.upper_bounds(v, d), v @ v.T
    for p in range(6):
        assert (scores[:, nearest == p].max(axis=1) <= bounds[:, p]).all()
    tenth = -np.sort(-scores, axis=1)[:, 9]
    assert (bounds < tenth[:, None]).mean() > 0.5


def test_best_entries_of_huge_scores():
    s = np.array([[2**62, -(2**62), 5, 2**62], [1, 1, 1, 0]])
    at, values = topk.best_entries(s, 2)
    assert {frozenset(zip(r, v)) for r, v in zip(at.tolist(), values.tolist())} == {frozenset({(0, 2**62), (3, 2**62)}), frozenset({(0, 1), (1, 1)})}
