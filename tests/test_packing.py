"""Greedy packing against a plain loop, and in linear time for a long document."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from docketry.operators import corpus

SCHEMA = "doc string, ord int, unit string, tokens int, has_table boolean, chunk_no int"


def plain(units, most, merge):
    """Chunks of one document's (unit, tokens, has_table): a table alone, a short tail to the chunk before."""
    chunks = []
    for unit, tokens, table in units:
        fits = chunks and not table and not chunks[-1][2] and (chunks[-1][1] == 0 or chunks[-1][1] + tokens <= most)
        if fits:
            chunks[-1] = (chunks[-1][0] + [unit], chunks[-1][1] + tokens, False)
        else:
            chunks.append(([unit], tokens, table))
    if len(chunks) > 1 and not chunks[-1][2] and not chunks[-2][2] and chunks[-1][1] < merge:
        tail = chunks.pop()
        chunks[-1] = (chunks[-1][0] + tail[0], chunks[-1][1] + tail[1], False)
    return [(i, u, t) for i, (u, t, _) in enumerate(chunks)]


def test_against_a_plain_loop(spark):
    rng = random.Random(1)
    docs = {f"d{i}": [(f"u{j}", rng.choice([0, 1, 5, 20, 40, 90]), rng.random() < 0.15) for j in range(rng.randrange(1, 40))] for i in range(60)}
    docs[None] = [("n", 3, False), ("m", 4, False)]
    rows = [(d, j, *u, 0) for d, units in docs.items() for j, u in enumerate(units)]
    rng.shuffle(rows)
    want = sorted(((d, *c) for d, units in docs.items() for c in plain(units, 50, 10)), key=repr)
    for n in (1, 7):
        got = corpus.packed(spark.createDataFrame(rows, SCHEMA).repartition(n), "doc", 50, 10)
        assert got.dtypes == [("doc", "string"), ("chunk_no", "int"), ("units", "array<string>"), ("tokens", "bigint")]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert corpus.packed(spark.createDataFrame([], SCHEMA), "doc").count() == 0


def test_nulls(spark):
    rows = [("d", 0, "a", None, False, 0), ("d", 1, None, 60, False, 0), ("d", 2, "c", 1, None, 0), ("d", 3, "e", 1, False, 0)]
    got = corpus.packed(spark.createDataFrame(rows, SCHEMA), "doc", 50, 10).orderBy("chunk_no").collect()
    assert [(r["units"], r["tokens"]) for r in got] == [(["a", None], 60), (["c"], 1), (["e"], 1)]


def test_a_long_document(spark):
    units = spark.range(200_000).select(F.lit("d").alias("doc"), F.col("id").alias("ord"), F.concat(F.lit("u"), "id").alias("unit"), F.lit(7).alias("tokens"), F.lit(False).alias("has_table"))
    began = time.perf_counter()
    row = corpus.packed(units, "doc", 70, 5).agg(F.count("*"), F.sum("tokens"), F.max(F.size("units")), F.min(F.size("units"))).first()
    assert tuple(row) == (20_000, 1_400_000, 10, 10)
    assert time.perf_counter() - began < 30


def test_latest_of_repeated_keys(spark):
    schema = "k string, v int, b string"
    old = spark.createDataFrame([("a", 9, "old"), ("b", 1, "old"), (None, 1, "old")], schema)
    new = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 0, "n"), ("c", 1, "c")], schema)
    assert sorted(map(tuple, corpus.upserted(old, new, "k", ("v",)).collect()), key=repr) == sorted([("a", 2, "z"), ("b", 1, "old"), (None, 0, "n"), ("c", 1, "c")], key=repr)
