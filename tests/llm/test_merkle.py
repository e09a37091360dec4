"""Merkle manifests against a plain tree that is built in memory."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from docketry.llm import merkle


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves: list[str], fan_out: int) -> tuple[str, list[list[list[str]]]]:
    """The node that remains, and for each leaf the other digests of its runs."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + fan_out] for i in range(0, len(nodes), fan_out)]
        for leaf, i in enumerate(at):
            run = runs[i // fan_out]
            proofs[leaf].append(run[: i % fan_out] + run[i % fan_out + 1 :])
        nodes, at = [sha(*r) for r in runs], [i // fan_out for i in at]
    return nodes[0], proofs


def plain_manifest(rows: list[tuple], fan_out: int) -> set[tuple]:
    """(source, id, leaf, subroot, root, digest of the proof) of each row of (source, id, leaf)."""
    by: dict = {}
    for source, i, leaf in rows:
        by.setdefault(source, []).append((i is not None, i or 0, leaf, i))
    trees = {s: plain_tree([leaf for _, _, leaf, _ in sorted(v, key=lambda r: r[:3])], fan_out) for s, v in by.items()}
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = plain_tree([trees[s][0] for s in order], fan_out)
    out = []
    for k, s in enumerate(order):
        for (_, _, leaf, i), proof in zip(sorted(by[s], key=lambda r: r[:3]), trees[s][1], strict=True):
            steps = proof + upper[k]
            out.append((s, i, leaf, trees[s][0], root, sha(*(d for step in steps for d in step))))
    return sorted(out, key=repr)


def found(df):
    cols = ("source", "doc_id", "leaf", "subroot", "root")
    return sorted((tuple(r) for r in df.select(*cols, merkle.proof_digest(F.col("proof"))).collect()), key=repr)


SCHEMA = "doc_id long, source string, leaf string, pos int, n long, tree string, digest string, at int"
BIG = 2**60

CASES = {
    "one row": [("a", 5)],
    "one source, one run": [("a", i) for i in range(3)],
    "one source, runs of one": [("a", i) for i in range(17)],
    "sources of one": [(f"s{i}", i) for i in range(20)],
    "uneven": [("hot", BIG + i) for i in range(70)] + [("", 3), (None, 4), (None, None), (None, None), ("é", 1), ("z", 1), ("Z", 2)] + [(f"x{i}", i) for i in range(9)],
    "repeats": [("a", 7)] * 40 + [("b", None)] * 3,
}


@pytest.mark.parametrize("fan_out", [2, 16])
@pytest.mark.parametrize("case", CASES)
def test_against_a_plain_tree(spark, case, fan_out):
    rows = [(s, i, sha(str(s), str(i))) for s, i in CASES[case]]
    df = spark.createDataFrame([(i, s, leaf, 1, 2, "t", "d", 3) for s, i, leaf in rows], SCHEMA)
    out = merkle.proofs(df, fan_out=fan_out)
    assert out.columns == ["source", "doc_id", "leaf", "subroot", "root", "proof"]
    assert found(out) == plain_manifest(rows, fan_out)
    assert out.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert out.where(merkle.folded(F.lit("0" * 64), F.col("proof")) == F.col("root")).count() == 0


def test_large_runs_of_jumps_and_salts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 3)
    rows = [(f"s{i % 3}", i, sha(str(i))) for i in range(150)]
    df = spark.createDataFrame([(i, s, leaf, 1, 2, "t", "d", 3) for s, i, leaf in rows], SCHEMA)
    assert found(merkle.proofs(df, fan_out=2)) == plain_manifest(rows, 2)


def test_no_rows(spark):
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_row_digest(spark):
    row = spark.createDataFrame([(12, None, "é", "")], "a long, b string, c string, d string").select(merkle.row_digest(*map(F.col, "abcd"))).first()[0]
    assert row == sha("2:12", "-", "2:é", "0:")
