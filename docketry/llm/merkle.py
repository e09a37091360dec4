"""Merkle manifest of a table: digests of rows, trees of runs, and proofs put together by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import parts_for, written

#: The tree over the subroots of all sources; trees of sources are named by the source.
TOP = "top"
#: Askers of one target of a jump that share a join key.
CHUNK = 4096
SEGMENTS = "array<struct<siblings:array<string>,at:int>>"


def row_digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values: each is `-` if null, else its UTF-8 bytes' count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in texts)), 256)


def run_digest(children: Column) -> Column:
    """Digest of a run of digests, joined as hex text."""
    return F.sha2(F.array_join(children, ""), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The digest at the end of a proof: at each step the digest takes its place among its siblings."""

    def step(own: Column, segment: Column) -> Column:
        others, at = segment["siblings"], segment["at"]
        return run_digest(F.concat(F.slice(others, 1, at), F.array(own), F.slice(others, at + 1, F.size(others))))

    return F.aggregate(proof, digest, step)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf to the root, left to right."""
    return run_digest(F.flatten(F.transform(proof, lambda s: s["siblings"])))


def node(tree: Column, level: Column | int, pos: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), pos.cast("long").alias("pos"))


def ranked(rows: DataFrame, tree: str, order: list[str], each: int = 100_000) -> DataFrame:
    """Rows with pos (from 0, by `order`, nulls first) and n (rows) within each tree, no tree in one task.

    Rows are dealt in ranges of (tree, order), so that a tree of any size spans as many tasks as it needs; a window inside
    each range and tree, and one over the ranges' counts, give the place. Rows that are alike in all of `order` are told
    apart by a number, so no range holds more than its share. rows must be a written table.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(parts_for(rows.count(), each), F.col(tree).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), "_row")
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(tree, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(tree).alias("_t"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(tree)).alias("n"))
    inside = Window.partitionBy("_part", tree).orderBy(*(F.col(c).asc_nulls_first() for c in order), "_row")
    placed = dealt.withColumn("_place", F.row_number().over(inside))
    joined = placed.join(counts, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t")))
    return joined.withColumn("pos", F.col("_before") + F.col("_place") - 1).drop("_row", "_part", "_place", "_t", "_p", "_before")


def runs_of(nodes: DataFrame, level: int, fan_out: int, child: list[str]) -> DataFrame:
    """The runs that are nodes of `level`: tree, pos, n (nodes of this level in the tree), children in order, digest.

    nodes: tree, pos, n, digest and the `child` columns of the level below; trees that have one node left give no run.
    """
    found = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {fan_out}").alias("_run"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *child))).alias("children"))
    return found.select("tree", F.lit(level).alias("level"), F.col("_run").alias("pos"), F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"), "children", run_digest(F.col("children.digest")).alias("digest"))


def tree_levels(leaves: DataFrame, most: int, fan_out: int, child: list[str]) -> list[DataFrame]:
    """Written runs of level 1, 2, ... up to one node in a tree of `most` leaves; `child` is carried by leaves only."""
    levels, nodes = [], leaves
    while most > 1:
        level = len(levels) + 1
        nodes = written(runs_of(nodes, level, fan_out, child if level == 1 else []), f"merkle-{level}")
        levels.append(nodes)
        most = -(-most // fan_out)
    return levels


def without_own(children: Column, at: Column) -> Column:
    """The segment of one child of a run: its siblings left to right, and its place."""
    digests = children["digest"]
    return F.array(F.struct(F.concat(F.slice(digests, 1, at), F.slice(digests, at + 2, F.size(digests))).alias("siblings"), at.alias("at")))


def links_of(runs: DataFrame, root: Column, child_id: Column, subroot: Column) -> DataFrame:
    """A row for each child of a run: its id, the run as its ancestor (null for the root), and the one segment between them."""
    c = runs.select("tree", "level", "pos", "n", "children", F.posexplode("children").alias("at", "c"))
    ancestor = F.when(~root, node(F.col("tree"), F.col("level"), F.col("pos")))
    return c.select(child_id.alias("id"), ancestor.alias("anc"), without_own(F.col("children"), F.col("at")).cast(SEGMENTS).alias("proof"), subroot.cast("string").alias("subroot"))


def jumped(links: DataFrame, depth: int) -> DataFrame:
    """Links whose proofs all reach the root, after log2(depth) self-joins that each double the ancestor's distance.

    Nodes that have arrived stay out of the joins. A far ancestor is asked by very many nodes: the asked ones alone stand in the
    join, each once for every salt, of which there are as many as it takes for CHUNK askers a key.
    """
    distance = 1
    while distance < depth:
        open_ = links.where("anc IS NOT NULL")
        asked = written(open_.groupBy("anc").agg(F.count("*").alias("_n")), "merkle-asked")
        salts = parts_for(asked.agg(F.max("_n")).first()[0] or 1, CHUNK)
        targets = links.join(asked.select(F.col("anc").alias("_id")), F.col("id") == F.col("_id"))
        targets = targets.select("_id", F.col("anc").alias("_anc"), F.col("proof").alias("_proof"), F.col("subroot").alias("_sub"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_copy"))
        salted = open_.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        hop = salted.join(targets, (F.col("anc") == F.col("_id")) & (F.col("_salt") == F.col("_copy")))
        hop = hop.select("id", F.col("_anc").alias("anc"), F.concat("proof", "_proof").alias("proof"), F.coalesce("subroot", "_sub").alias("subroot"))
        links = written(links.where("anc IS NULL").unionByName(hop), "merkle-jump")
        distance *= 2
    return links


def proofs(rows: DataFrame, source_col: str = "source", id_col: str = "doc_id", digest_col: str = "leaf", carry: tuple[str, ...] = (), fan_out: int = 16) -> DataFrame:
    """One row for each input row: source, id, digest and `carry` columns, subroot, root and proof.

    Leaves of a source ascend by id, nulls first, equal ids by digest; repeated rows are leaves of their own. While a tree has
    several nodes, each fan_out consecutive ones become their digest; the last run may be shorter. The subroots, by source,
    null first, then bytewise, form the tree above. proof: for each step from leaf to root the run's other digests, left to
    right, and the own place among them; `folded` and `proof_digest` read it. A table of one row has an empty proof; an
    empty table gives no rows. Other columns are ignored; `carry` columns must be orderable.

    Leaves are numbered by ranges, so no source is in one task. Every level is a written table a fan_out-th of the one
    below. Proofs are put together for the runs, by pointer jumping over their links; the leaves of a run come last and take
    over what their run has, so they are shuffled once. The driver learns counts and the root, nothing else.
    """
    carried = [f"_k_{c}" for c in carry]
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("tree")
    own = written(rows.select(tree, F.col(id_col).alias("_id"), F.col(digest_col).alias("digest"), *(F.col(c).alias(k) for c, k in zip(carry, carried, strict=True))), "merkle-rows")
    leaves = written(ranked(own, "tree", ["_id", "digest"]), "merkle-leaves")
    child = ["_id", *carried]
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = tree_levels(leaves, most, fan_out, child)

    subroots = leaves.where("n = 1").select("tree", F.lit(0).alias("level"), "digest")
    for runs in levels:
        subroots = subroots.unionByName(runs.where("n = 1").select("tree", "level", "digest"))
    subroots = ranked(written(subroots, "merkle-subroots").withColumn("_top", F.lit(TOP)), "_top", ["tree"])
    upper = written(subroots.select(F.lit(TOP).alias("tree"), "pos", "n", "digest", node(F.col("tree"), F.col("level"), F.lit(0)).alias("child")), "merkle-top")
    sources = upper.agg(F.max("n")).first()[0] or 0
    top_levels = tree_levels(upper, sources, fan_out, ["child"])
    last = (top_levels or [upper])[-1].first()
    root = F.lit(last["digest"] if last else None).cast("string")

    c, one_left, none = F.col("c"), F.col("n") == 1, F.array().cast(SEGMENTS)
    below = node(F.col("tree"), F.col("level") - 1, c["pos"])
    parts = [links_of(runs, one_left & F.lit(sources == 1), below, F.lit(None)) for runs in levels[1:]]
    parts += [links_of(runs, one_left, c["child"], c["digest"]) if i == 0 else links_of(runs, one_left, below, F.lit(None)) for i, runs in enumerate(top_levels)]

    single = leaves.where("n = 1").select(node(F.col("tree"), 0, F.lit(0)).alias("at_id"), "tree", F.array(F.struct("pos", "digest", *child)).alias("children"), F.lit(False).alias("in_run"))
    for runs in levels[:1]:
        single = single.unionByName(runs.select(node(F.col("tree"), 1, F.col("pos")).alias("at_id"), "tree", "children", F.lit(True).alias("in_run")))
    if parts:
        links = parts[0]
        for p in parts[1:]:
            links = links.unionByName(p)
        links = jumped(written(links, "merkle-links"), len(levels[1:]) + len(top_levels))
        single = single.join(links.select("id", "proof", "subroot"), F.col("at_id") == F.col("id"), "left")
    else:
        single = single.withColumns({"proof": none, "subroot": F.lit(None).cast("string")})
    each = single.select("tree", "children", "in_run", "proof", "subroot", F.posexplode("children").alias("at", "c"))
    first = F.when(F.col("in_run"), without_own(F.col("children"), F.col("at")).cast(SEGMENTS)).otherwise(none)
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).cast(rows.schema[source_col].dataType)
    subroot = F.coalesce("subroot", F.when(F.col("in_run"), root).otherwise(c["digest"]))
    return each.select(
        source.alias(source_col), c["_id"].alias(id_col), c["digest"].alias(digest_col), *(c[k].alias(n) for n, k in zip(carry, carried, strict=True)),
        subroot.alias("subroot"), root.alias("root"), F.concat(first, F.coalesce("proof", none)).alias("proof"),
    )
