"""Mixing sources to target weights over a tree of groups. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import spread_join, written

WORD = r"[^\x20\x09-\x0D]+"
#: Leaves up to which their table is sent to every executor; beyond, documents meet it by a shuffle.
BROADCAST_LEAVES = 100_000
#: Slices of each leaf's order, of which one at most is cut inside, and rows for which there is one more.
SLICES, ROWS_A_SLICE = 1024, 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(nodes: DataFrame, parent: Sequence[str], budget: Column) -> DataFrame:
    """Adds `budget` to sibling nodes with columns w and cap: in proportion to w, none above its cap, what a full node
    leaves going to its siblings. nodes already carries the parent's budget. Nodes without weight get nothing.

    Sorted by cap / w, the full nodes come first; the level of the first node that isn't full holds for all after it.
    """
    by = Window.partitionBy(*parent).orderBy("_ratio", "_w", "_node") if parent else Window.partitionBy(F.lit(0)).orderBy("_ratio", "_w", "_node")
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = nodes.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(0.0)).withColumn("_level", F.when(weight > 0, (budget - before) / weight).otherwise(0.0))
    open_level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0)))
    full = F.col("_ratio") <= F.col("_level")
    return leveled.withColumn("_open", open_level).withColumn("_given", F.when(full, F.col("_cap")).otherwise(F.col("_open") * F.col("_w"))).drop("_ratio", "_level", "_open")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[tuple], total: float | None, share: float, max_epochs: int) -> DataFrame:
    """Leaf columns, supply (tokens) and budget (whole tokens) from the top of the tree down.

    weights: (path, weight), a path naming a node by the values of the first levels; nodes not named weigh 1, of a path
    given twice the last weight holds. The children of one node are ordered in one task, as rows of three numbers. A node's
    cap is its leaves' tokens times max_epochs. What a node can't use stays with its siblings, and leaves their parent only when all of
    them are full, since the parent's own cap is the sum of theirs.
    """
    spark = leaves.sparkSession
    given = leaves
    for depth in range(1, len(levels) + 1):
        named = [(*path, float(w)) for path, w in dict(weights).items() if len(path) == depth]
        names = ", ".join([*(f"{c} string" for c in levels[:depth]), f"_w{depth} double"])
        given = given.join(F.broadcast(spark.createDataFrame(named, names)), list(levels[:depth]), "left").na.fill(1.0, [f"_w{depth}"])
    weightless = F.lit(False)
    for depth in range(1, len(levels) + 1):
        weightless |= F.col(f"_w{depth}") <= 0
    given = given.withColumn("_leafcap", F.when(weightless, 0.0).otherwise(F.col("supply") * float(max_epochs)))
    root = given.agg(F.coalesce(F.sum("_leafcap"), F.lit(0.0)).alias("cap"), F.coalesce(F.sum("supply"), F.lit(0)).alias("supply"))
    wanted = F.lit(float(total)) if total is not None else F.col("supply") * share
    budgets = root.select(F.least(wanted, F.col("cap")).alias("_budget"))
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        nodes = given.groupBy(*path).agg(F.sum("_leafcap").alias("_cap"), F.greatest(F.max(f"_w{depth}"), F.lit(0.0)).alias("_w")).withColumn("_node", F.col(path[-1]))
        placed = nodes.crossJoin(F.broadcast(budgets)) if depth == 1 else nodes.join(budgets, path[:-1])
        budgets = water_filled(placed, path[:-1], F.col("_budget")).select(*path, F.col("_given").alias("_budget"))
    # A hair's breadth of floating point must not cost a whole token.
    return leaves.join(budgets, list(levels)).select(*levels, "supply", F.floor(F.col("_budget") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame,
    levels: Sequence[tuple[str, Column]],
    weights: Sequence[tuple] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    total_tokens: float | None = None,
    share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 0,
    broadcast_leaves: int = BROADCAST_LEAVES,
) -> DataFrame:
    """One row for each document row: id, text_hash, the tree's columns, n_tokens, n_copies (0 if not selected).

    levels: the tree's names and expressions from the top down, such as domain, language, source; null is the node ''.
    The budget is total_tokens, or `share` of all tokens, but never more than max_epochs times all tokens. It goes down the tree by weight
    (`leaf_budgets`). A leaf with budget b and supply s takes floor(b / s) whole epochs and, of the next epoch's order
    (a hash of seed, epoch, id and text), the longest prefix within what is left. Tokens are words between space
    characters; null and empty texts have none. Repeated rows have equal places in the order and are counted one by one;
    an empty table gives no rows; other columns are ignored.

    A leaf is never sorted as a whole: its order is cut in slices by hash, more as the rows are more, slices are summed with partial sums, and only
    the one slice in which the budget ends is ordered row by row. Only (id, leaf, tokens, hash) rows are shuffled.
    """
    names = [n for n, _ in levels]
    rows = written(
        docs.select(
            F.col(id_col).alias("_id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
            *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels),
            n_words(F.col(text_col)).alias("n_tokens"),
        ),
        "mixing",
    )
    leaves = written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("supply")), "leaves")
    n = leaves.count()
    budgets = leaf_budgets(leaves, names, weights, total_tokens, share, max_epochs)
    plan = written(
        budgets.select(
            *names,
            F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0).cast("int").alias("_epochs"),
            F.when(F.col("supply") > 0, F.col("budget") % F.col("supply")).otherwise(0).alias("_left"),
        ),
        "plan",
    )
    order = F.xxhash64(F.lit(seed), F.col("_epochs"), F.col("_id"), F.col("text_hash"))
    slices = SLICES + rows.count() // ROWS_A_SLICE

    def with_leaf(df: DataFrame, leaf: DataFrame) -> DataFrame:
        """Left join with a table of leaves: sent to all executors if they are few, else met by a shuffle that splits large leaves."""
        if n <= broadcast_leaves:
            return df.join(F.broadcast(leaf), names, "left")
        named = leaf.select(*(F.col(c).alias(f"_l_{c}") for c in names), *(c for c in leaf.columns if c not in names))
        same = reduce(Column.__and__, [F.col(c) == F.col(f"_l_{c}") for c in names])
        return spread_join(df, named, same, F.struct("_id", "text_hash")).drop(*(f"_l_{c}" for c in names))

    placed = with_leaf(rows, plan).withColumn("_order", order)
    placed = placed.withColumn("_slice", F.least(F.floor((F.col("_order").cast("double") / 2.0**64 + 0.5) * slices), F.lit(slices - 1)).cast("int"))
    sums = placed.groupBy(*names, "_slice").agg(F.sum("n_tokens").alias("_sum"), F.first("_left").alias("_left"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("_before", before).where(F.col("_before") + F.col("_sum") > F.col("_left"))
    cut = ends.groupBy(*names).agg(F.min("_slice").alias("_cut"), F.min_by("_before", "_slice").alias("_before"))
    marked = with_leaf(placed, written(cut, "cut"))
    inside = Window.partitionBy(*names).orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = marked.where(F.col("_cut").isNull() | (F.col("_slice") != F.col("_cut")))
    whole = whole.withColumn("_more", (F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut"))).cast("int"))
    split = marked.where(F.col("_slice") == F.col("_cut")).withColumn("_more", (F.col("_before") + F.sum("n_tokens").over(inside) <= F.col("_left")).cast("int"))
    columns = [F.col("_id").alias(id_col), "text_hash", *names, "n_tokens", (F.col("_epochs") + F.col("_more")).alias("n_copies")]
    return whole.select(*columns).unionByName(split.select(*columns))
