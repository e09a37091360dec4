"""The two legs of retrieval against all pairs, in one block and in many; only a block's best are ranked."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from docketry.operators import retrieval


def ranked_rows(monkeypatch):
    """The number of scored rows that each ranking gets."""
    seen, own = [], retrieval.ranked

    def counting(scored, *args):
        seen.append(scored.count())
        return own(scored, *args)

    monkeypatch.setattr(retrieval, "ranked", counting)
    return seen


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b)


@pytest.mark.parametrize("blocks", [(8_192, 16_384), (5, 40)])
@pytest.mark.parametrize("within", [(), ("program",)])
def test_dense_against_all_pairs(spark, monkeypatch, blocks, within):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks[0], raising=False)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", blocks[1], raising=False)
    rng = random.Random(5)
    vectors = [[float(rng.randrange(-3, 4)) for _ in range(4)] for _ in range(60)]
    pool = [*vectors, None, [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, 2.0], [], [math.nan, 1.0, 2.0, 3.0]]
    items = [(i, rng.choice(pool) if i > 5 else pool[-1 - i], rng.choice([0, 1, 2])) for i in range(150)] + [(200 + i, vectors[0], 1) for i in range(90)]
    asked = [(i, v) for i, v in enumerate([*vectors[:8], *pool[-6:]])]
    q, c = spark.createDataFrame(asked, "query_id long, embedding array<float>"), spark.createDataFrame(items, "chunk_id long, embedding array<float>, program int")
    got = {(r["query_id"], r["program"] if within else 0, r["rank"]): (r["chunk_id"], r["cosine"]) for r in retrieval.dense(q, c, 6, carry=("program",), within=within).collect()}
    want = {}
    for i, a in asked:
        for g in (0, 1, 2) if within else (0,):
            known = [(cosine(a, b), j) for j, b, p in items if not within or p == g]
            order = sorted(known, key=lambda s: (s[0] is None, s[0] is not None and not math.isnan(s[0]), -(0.0 if s[0] is None or math.isnan(s[0]) else s[0]), s[1]))
            want |= {(i, g, k): (j, s) for k, (s, j) in enumerate(order[:6])}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and (got[k][1] == want[k][1] or math.isnan(got[k][1]) and math.isnan(want[k][1])), (k, got[k], want[k])


def test_dense_ranks_the_best_of_blocks(spark, monkeypatch):
    seen, rng = ranked_rows(monkeypatch), random.Random(6)
    c = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(2000)], "chunk_id long, embedding array<double>")
    q = c.where("chunk_id < 50").withColumnRenamed("chunk_id", "query_id")
    assert retrieval.dense(q, c, 4).count() == 200 and seen == [200]


@pytest.mark.parametrize("size", [48_000_000, 300])
def test_keyword_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", size, raising=False)
    monkeypatch.setattr(retrieval, "SET_BLOCK", 9 if size < 1_000 else 100_000, raising=False)
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["Un", "deux", "trois", "QUATRE", "été", "x1", "x2", "x3"]) for _ in range(n))
    items = [(i, text(rng.randrange(9))) for i in range(80)] + [(3, "un deux un"), (3, "un deux un trois"), (7, None), (9, ""), (11, "..."), (12, "un deux"), (13, "deux un"), (None, "un deux")]
    asked = [(i, text(1 + i % 3)) for i in range(40)] + [(50, "deux, un"), (51, "un deux"), (52, "none such"), (53, None), (54, "")]
    words = lambda t: [w for w in (t or "").lower().replace(",", " ").replace(".", " ").split(" ") if w]
    chunks: dict = {}
    for i, t in items:
        chunks[i, len(words(t))] = chunks.get((i, len(words(t))), Counter()) + Counter(words(t))
    want = {}
    for i, t in asked:
        ws = set(words(t))
        hits = sorted((-sum(n[w] for w in ws) / size_, j is not None, j or 0) for (j, size_), n in chunks.items() if ws and ws <= n.keys())
        want |= {(i, k): (j if known else None, -s) for k, (s, known, j) in enumerate(hits[:5])}
    found = retrieval.keyword(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(items, "chunk_id long, content string"), 5)
    assert {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in found.collect()} == want


def test_keyword_ranks_the_best_of_blocks(spark, monkeypatch):
    seen = ranked_rows(monkeypatch)
    c = spark.createDataFrame([(i, f"the and of w{i % 7}") for i in range(2000)], "chunk_id long, content string")
    q = spark.createDataFrame([(i, f"the and w{i % 7}") for i in range(100)], "query_id long, text string")
    assert retrieval.keyword(q, c, 4).count() == 400 and seen == [28]
