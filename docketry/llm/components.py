"""Connected components of links, as joins and sums: alternating large and small stars until nothing moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import written

#: Parts that every group is cut in, at least, and rows for which there is one more.
SALTS, ROWS_A_SALT = 16, 1_000_000


def attached(rows: DataFrame, key: str, row: Column, n_rows: int, size: str = "_size", **least: Column) -> DataFrame:
    """rows with their group's size and the group's least value of each named column; `row` tells rows of a group apart.

    A group's rows are dealt by a salt before they are summed or joined, so a group that holds most rows is no hot task;
    one group's parts are as many as the salts.
    """
    salts = SALTS + n_rows // ROWS_A_SALT
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    # Which parts a group has goes along as bits, so that the sums of a group reach its parts without a join of their own.
    words = range(0, salts, 63)
    held = [F.expr(f"bit_or(CASE WHEN _salt >= {w} AND _salt < {w + 63} THEN shiftleft(1L, CAST(_salt - {w} AS INT)) ELSE 0L END)").alias(f"_in_{w}") for w in words]
    whole = salted.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(size), *(F.min(c).alias(name) for name, c in least.items()), *held)
    parts = F.concat(*(F.expr(f"filter(sequence({w}L, {min(w + 63, salts) - 1}L), x -> getbit(_in_{w}, CAST(x - {w} AS INT)) = 1)") for w in words))
    return salted.join(whole.withColumn("_salt", F.explode(parts)).drop(*(f"_in_{w}" for w in words)), [key, "_salt"]).drop("_salt")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = attached(both, "a", F.col("b"), 2 * n, m=F.col("b"))
    return near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = attached(down, "a", F.col("b"), n, m=F.col("b"))
    return near.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def _moving(edges: DataFrame) -> int:
    """How many links there are, or 0 where each node has one link to its root and no root has a link: nothing would move."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    now = nodes.agg(F.sum("up").alias("n"), F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open")).first()
    return now["n"] if now["open"] else 0


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that links name; links has whole numbers a and b.

    Every round is written to the shared folder, so a lost executor costs one round. Self-links and repeated links don't
    matter; rows with nulls are dropped; no links give no rows.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    while (n := _moving(edges)) > 0:
        edges = written(_small_star(_large_star(edges, n), n), "links")
    root = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
