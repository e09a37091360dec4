"""Exact top-k search by inner product: vectors keyed by nearest pivot and distance, annuli expanded until their bounds rule them out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import map_arrow, parts_for, spread_join, written

#: Products below this are exact in float64, whatever the order of the sums.
EXACT = float(2**53)


@dataclass(frozen=True)
class Directory:
    """The index's annuli: bounded by pivots and rings, whatever the rows."""

    pivots: np.ndarray  # of norm `reach`, the last coordinate makes up for the norm
    reach: float  # the largest norm
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    first_block: np.ndarray
    blocks: np.ndarray


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix; shorter vectors end in zeros."""
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(arrays.offsets.to_numpy()), arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(arrays), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def lifted(v: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with one more coordinate that gives all the same norm, so that nearer means a larger inner product."""
    v = v.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(0.0, reach * reach - (v * v).sum(axis=1)))]


def far_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample, each the one farthest from those before it."""
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def upper_bounds(queries: np.ndarray, d: Directory) -> np.ndarray:
    """For each query and annulus the largest score that the triangle inequality leaves possible, as a whole number."""
    q = queries.astype(np.float64)
    norm2 = (q * q).sum(axis=1)[:, None] + d.reach * d.reach
    to_pivot = np.sqrt(np.maximum(0.0, norm2 - 2.0 * (q @ d.pivots[:, :-1].T)))[:, d.pivot]
    gap = np.maximum(0.0, np.maximum(to_pivot - d.high, d.low - to_pivot))
    return np.floor((norm2 - gap * gap) / 2.0 + 1e-9 * norm2 + 1e-6)


def best_entries(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k largest of each row, smaller places first among equals; the order within a row is open."""
    n = scores.shape[1]
    k = min(k, n)
    if float(np.abs(scores).max(initial=0)) * n < 2**62:
        keys = scores * n + np.arange(n - 1, -1, -1)
        keys = np.partition(keys, n - k, axis=1)[:, n - k :]
        s = keys // n
        return n - 1 - (keys - s * n), s
    at = np.argsort(np.invert(scores), axis=1, kind="stable")[:, :k]  # ~x falls as x grows and never overflows
    return at, np.take_along_axis(scores, at, axis=1)


def scored_block(asks: pa.Table, rows: pa.Table, dim: int, k: int, sub: int = 256) -> pa.Table:
    """The best k entries of one block for each query that asks it, above the query's floor."""
    out = {c: [] for c in ("h1", "h2", "vec_id", "c1", "c2", "score")}
    if asks.num_rows and rows.num_rows:
        ids = rows.column("ids").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
        flat = ids.flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        c1, c2 = (rows.column(c).to_numpy()[owner] for c in ("h1", "h2"))
        vectors = matrix(rows.column("v"), dim)[owner]
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max())
        for a in asks.to_pylist():
            keys, floors = np.frombuffer(a["queries"], np.int64).reshape(-1, 2), np.frombuffer(a["floors"], np.float64)
            q = np.frombuffer(a["vectors"], a["kind"]).reshape(len(keys), dim)
            exact = norm * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max()) < EXACT
            kind = np.float64 if exact else np.int64
            turned = vectors.T.astype(kind)
            for at in range(0, len(q), sub):
                places, s = best_entries((q[at : at + sub].astype(kind) @ turned).astype(np.int64), k)
                who, col = np.nonzero(s >= floors[at : at + sub, None])
                place = places[who, col]
                for c, values in zip(out, (keys[at + who, 0], keys[at + who, 1], flat[place], c1[place], c2[place], s[who, col]), strict=True):
                    out[c].append(values)
    return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for c, v in out.items()})


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, v (floor of scale times each component), h1 and h2 (128 bits that stand for v) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    taken = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    v = taken.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))
    return v.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def build_index(classes: DataFrame, pivots: int, sample: int, rings: int, block_rows: int) -> tuple[DataFrame, Directory, int]:
    """The written index (block, ids, h1, h2, v), its directory, and the number of components.

    classes: written rows of distinct vectors with h1, h2, v, ids. Pivots are fitted on at most `sample` rows, those of the
    smallest hashes, every row is indexed. A ring is a step of distance from the nearest pivot; rings next to each other
    become one annulus while they hold under block_rows rows, and a ring of more is dealt in blocks by its rows' hashes.
    """
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = classes.agg(F.max(norm2).alias("norm2"), F.max(F.size("v")).alias("dim")).first()
    reach, dim = float(np.sqrt(most["norm2"])) * (1 + 1e-12), max(1, most["dim"])
    fitted = classes.orderBy("h1", "h2").select("v").limit(sample).toArrow()
    pivot_rows = far_pivots(lifted(matrix(fitted.column("v"), dim), reach), pivots)
    width = max(2.0 * reach / rings, 1e-9)

    def keyed(batch: pa.RecordBatch) -> pa.Table:
        v = lifted(matrix(batch.column("v"), dim), reach)
        distance = np.sqrt(np.maximum(0.0, 2.0 * reach * reach - 2.0 * (v @ pivot_rows.T)))
        nearest = distance.argmin(axis=1)
        own = distance[np.arange(len(v)), nearest]
        ring = np.minimum(own // width, rings).astype(np.int32)
        return pa.table({**{c: batch.column(c) for c in ("h1", "h2", "v", "ids")}, "pivot": nearest.astype(np.int32), "ring": ring, "distance": own})

    placed = written(map_arrow(classes.select("h1", "h2", "v", "ids"), keyed, "h1 long, h2 long, v array<long>, ids array<long>, pivot int, ring int, distance double"), "topk-keyed")
    counted = placed.groupBy("pivot", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
    annuli: list[list] = []  # pivot, low, high, rows
    of: list[tuple[int, int, int]] = []  # pivot, ring, annulus
    for r in sorted(counted.collect(), key=lambda r: (r["pivot"], r["ring"])):
        last = annuli[-1] if annuli else None
        if last and last[0] == r["pivot"] and last[3] + r["n"] <= block_rows:
            last[2], last[3] = r["high"], last[3] + r["n"]
        else:
            annuli.append([r["pivot"], r["low"], r["high"], r["n"]])
        of.append((r["pivot"], r["ring"], len(annuli) - 1))
    pivot, low, high, rows = (np.array(x) for x in zip(*annuli, strict=True))
    blocks = -(-rows // block_rows)
    slack = 1e-7 * reach + 1e-9
    d = Directory(pivot_rows, reach, pivot, low - slack, high + slack, rows, np.cumsum(blocks) - blocks, blocks)
    places = placed.sparkSession.createDataFrame([(p, g, int(d.first_block[a]), int(blocks[a])) for p, g, a in of], "pivot int, ring int, first long, n_blocks long")
    # At most pivots * (rings + 1) rows.
    joined = placed.join(F.broadcast(places), ["pivot", "ring"])
    return joined.select((F.col("first") + F.pmod("h2", F.col("n_blocks"))).alias("block"), "ids", "h1", "h2", "v"), d, dim


def top_k(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    pivots: int = 64,
    sample: int = 2048,
    rings: int = 256,
    block_rows: int = 4096,
    first: int = 16_384,
    growth: int = 8,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each query the k largest inner products, ties to the smaller vec_id.

    Queries are the rows whose id `is_query` holds for; candidates are all rows but the query's own. Rows whose id is null,
    whose vector is null or holds null or non-finite components, take no part. An empty vector, and the missing places of
    a shorter one, count as zeros. Repeated rows count once; rows that share an id but not the vector are candidates and
    queries of their own. Scores must fit a long. Other columns are ignored; an empty table gives no rows.

    Equal vectors are indexed once, with their k + 1 smallest ids (no query can need more), cut before the shuffle: a vector of a third of
    all rows is one entry. A query visits annuli by falling bound: `first` rows, then `growth` times as many, until no
    annulus that is left can hold a score as high as its k-th; each annulus is visited once. Blocks of queries meet blocks of
    vectors, each pair in a task of bounded size. Exact, however little the bounds rule out.
    """
    kept = k + 1
    rows = whole_numbers(vectors, id_col, vector_col, scale)
    by_id = Window.partitionBy("h1", "h2").orderBy("vec_id")
    smallest = rows.distinct().withColumn("_place", F.row_number().over(by_id)).where(F.col("_place") <= kept)
    classes = written(smallest.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "topk-classes")
    asking = rows.where(is_query(F.col("vec_id")))
    queries = written(asking.groupBy("h1", "h2").agg(F.first("v").alias("v")), "topk-queries")
    n_queries, n_classes = queries.count(), classes.count()
    spark = vectors.sparkSession
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, d, dim = build_index(classes, pivots, sample, rings, block_rows)
    index, salts = written(index, "topk-index"), parts_for(n_queries, 64_000)

    def asked(lower: int, upper: int) -> Callable[[pa.RecordBatch], pa.Table]:
        """Asks for the annuli whose place, by falling bound, is from `lower` to `upper` rows on."""

        def run(batch: pa.RecordBatch) -> pa.Table:
            keys = np.c_[batch.column("h1").to_numpy(), batch.column("h2").to_numpy()]
            v = matrix(batch.column("v"), dim)
            floors = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            floors = np.where(np.isnan(floors), -np.inf, floors)
            wanted: dict[int, list[np.ndarray]] = {}
            for at in range(0, len(v), 64):
                bounds = upper_bounds(v[at : at + 64], d)
                order = np.argsort(-bounds, axis=1, kind="stable")
                before = np.cumsum(d.rows[order], axis=1) - d.rows[order]
                due = (before >= lower) & (before < upper) & (np.take_along_axis(bounds, order, axis=1) >= floors[at : at + 64, None])
                who, place = np.nonzero(due)
                annulus = order[who, place]
                for a in np.unique(annulus):
                    wanted.setdefault(int(a), []).append(at + who[annulus == a])
            size = np.abs(v).max(initial=0)
            kind = "<i2" if size < 2**15 else "<i4" if size < 2**31 else "<i8"
            out = []
            for a, parts in wanted.items():
                who = np.concatenate(parts)
                packed = {"queries": keys[who].tobytes(), "floors": floors[who].tobytes(), "vectors": v[who].astype(kind).tobytes(), "kind": kind}
                out += [{"block": int(d.first_block[a]) + j, "salt": int(keys[0, 0] % salts), **packed} for j in range(int(d.blocks[a]))]
            return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("salt", pa.int64()), ("queries", pa.binary()), ("floors", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string())]))

        return run

    score = lambda asks, entries: scored_block(asks, entries, dim, kept)
    copied = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    by_score = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id", "c1", "c2")
    best: DataFrame | None = None
    lower, upper = 0, first
    while lower < n_classes:
        if best is None:
            floored = queries.withColumn("floor", F.lit(None).cast("double"))
        else:
            floor = best.groupBy("h1", "h2").agg(F.when(F.count("*") == kept, F.min("score")).cast("double").alias("floor"))
            floored = queries.join(floor, ["h1", "h2"], "left")
        asks = map_arrow(floored.select("h1", "h2", "v", "floor"), asked(lower, upper), "block long, salt long, queries binary, floors binary, vectors binary, kind string")
        found = asks.groupBy("block", "salt").cogroup(copied.groupBy("block", "salt")).applyInArrow(score, "h1 long, h2 long, vec_id long, c1 long, c2 long, score long")
        found = found if best is None else best.unionByName(found)
        best = written(found.withColumn("_place", F.row_number().over(by_score)).where(F.col("_place") <= kept).drop("_place"), "topk-best")
        lower, upper = upper, upper * growth
    lists = best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id", "c1", "c2"))).alias("best")).withColumnsRenamed({"h1": "_q1", "h2": "_q2"})
    each = spread_join(asking.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct(), lists, (F.col("h1") == F.col("_q1")) & (F.col("h2") == F.col("_q2")), F.col("query_id"))
    others = F.filter("best", lambda e: ~((e["vec_id"] == F.col("query_id")) & (e["c1"] == F.col("h1")) & (e["c2"] == F.col("h2"))))
    listed = each.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "e"))
    return listed.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.low")).alias("score"))
