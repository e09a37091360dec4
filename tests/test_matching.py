"""Names matched through their grams against all pairs scored, and one-to-one matches against a plain greedy pass."""

from __future__ import annotations

import difflib
import random

import pytest

from docketry.operators import matching


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def names(seed, n, letters="ABCDE ", most=12):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.choice(out)[1] if out and rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
        if base and rng.random() < 0.7:
            at = rng.randrange(len(base))
            base = base[:at] + rng.choice(["", rng.choice(letters), base[at] + rng.choice(letters)]) + base[at + 1 :]
        out.append((f"b{rng.randrange(2)}", base))
    return out


@pytest.mark.parametrize("t", [0.5, 0.6, 0.7, 0.85, 0.95, 1.0])
def test_similar_names_against_all_pairs(spark, t):
    left, right = names(1, 120), [*names(2, 120), *names(1, 40), ("b0", "É" * 3), ("b0", "X" * 250 + "Y"), ("b1", "")]
    left += [("b0", "É" * 4), ("b0", "X" * 250 + "Z"), ("b1", ""), ("b1", None)]
    want = {(b, x, y, ratio(x, y)) for b, x in left if x is not None for c, y in right if b == c and ratio(x, y) >= t}
    schema = "bundle_id string, name string"
    got = matching.similar_names(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), t).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_only_pairs_that_can_pass_are_scored(spark, monkeypatch):
    """A large bundle of unlike names: what meets is a small share of all pairs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(6))
    left, right = ([("b", f"{word()} {word()} {word()}") for _ in range(1500)] for _ in range(2))
    seen = spark.sparkContext.accumulator(0)
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def counting(a, b):
        import pandas as pd

        seen.add(len(a))
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])

    monkeypatch.setattr(matching, "ratio", counting)
    schema = "bundle_id string, name string"
    right = right + left[:50]
    found = matching.similar_names(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.85)
    assert found.count() >= 50 and seen.value < 1500 * 1550 / 500


def greedy(people, candidates, t):
    scored = [(-ratio(n, m), po, k, co, j, b) for b, k, n, po in people for c, j, m, co in candidates if b == c and n is not None and m is not None and ratio(n, m) >= t]
    taken, out = set(), set()
    for s, _, k, _, j, b in sorted(scored):
        if (b, "p", k) not in taken and (b, "c", j) not in taken:
            taken |= {(b, "p", k), (b, "c", j)}
            out.add((b, k, j, -s))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_matched_against_a_plain_greedy_pass(spark, seed):
    rng = random.Random(seed)
    pool = [n for _, n in names(seed, 12, "ABC", 9)]
    people = [(f"b{i % 2}", f"p{i}", rng.choice(pool), i) for i in range(40)] + [("b0", "pn", None, 41)]
    candidates = [(f"b{i % 2}", f"c{i}", rng.choice(pool), i) for i in range(40)] + [("b0", "cn", None, 41)]
    schema = "bundle_id string, key string, name string, ord int"
    p, c = spark.createDataFrame(people, schema), spark.createDataFrame(candidates, schema)
    normal = lambda rows: [(b, k, None if n is None else " ".join(n.upper().split()), o) for b, k, n, o in rows]
    want = greedy(normal(people), normal(candidates), 0.7)
    assert {tuple(r) for r in matching.matched(p, c, 0.7).collect()} == want
    assert {tuple(r) for r in matching.assigned(matching.scored_pairs(p, c, 0.7)).collect()} == want


def test_only_names_with_another_side_are_cut_into_grams(spark, monkeypatch):
    seen, own = [], matching.name_keys

    def counting(names, *args):
        seen.append(sorted((r["bundle_id"], r["name"], r["side"]) for r in names.collect()))
        return own(names, *args)

    monkeypatch.setattr(matching, "name_keys", counting)
    left = [("b0", "ABCDEFGH"), ("b1", "ABCDEFGH"), ("b2", "ABCDEFGH"), ("b3", None), (None, "ABCDEFGH")]
    right = [("b0", "ABCDEFGX"), ("b2", None), ("b3", "ABCDEFGH"), ("b4", "ABCDEFGH"), (None, "ABCDEFGH")]
    schema = "bundle_id string, name string"
    found = matching.similar_names(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.8).collect()
    assert [tuple(r) for r in found] == [("b0", "ABCDEFGH", "ABCDEFGX", 0.875)]
    assert seen == [[("b0", "ABCDEFGH", "l"), ("b0", "ABCDEFGX", "r")]]
