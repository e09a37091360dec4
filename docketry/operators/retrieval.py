"""Retrieval over a table of chunks for many queries at once: filter, vector leg, keyword leg, fusion, floor, top k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import page_of

#: Query vectors, and vectors, of one block of the dense leg; each block of the one meets each of the other.
QUERY_BLOCK, VECTOR_BLOCK = 8_192, 16_384
#: Bytes of text of one block of the keyword leg, and word sets that meet a block at a time.
TEXT_BLOCK, SET_BLOCK = 48_000_000, 100_000
#: More than the order of its sums can change in the cosine of two unit vectors.
ROUNDING = 1e-12


def admissible(chunks: DataFrame, as_of: Column, corpora: list[str] | None = None, channel: str = "customer", program: str | None = None) -> DataFrame:
    """Chunks that may be shown: of the corpora, not expired, and for customers neither internal nor waiting for review.

    Filters stand before any ranking, so they reach the scan.
    """
    out = chunks.where(F.col("expiry_date").isNull() | (F.col("expiry_date") > as_of))
    if corpora is not None:
        out = out.where(F.col("corpus").isin(*corpora))
    if channel == "customer":
        out = out.where((F.col("access_tier") != "internal") & ~F.col("needs_review"))
    return out.where(F.col("program_code") == program) if program else out


def ranked(scored: DataFrame, query: str, score: str, item: str, most: int, within: list[str] | None = None) -> DataFrame:
    """The best `most` of each query, rank from 0; ties by id. Partitions drop what can't be among them before the shuffle."""
    by = Window.partitionBy(query, *(within or [])).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < most)


def places(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each value among the distinct values in order, null first."""
    coded = pa.concat_arrays(column.chunks or [pa.array([], column.type)]).dictionary_encode(null_encoding="encode")
    if not len(coded):
        return np.empty(0, np.int64)
    order = pc.rank(coded.dictionary, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    return order[coded.indices.to_numpy()].astype(np.int64)


def leading(most: int, *keys: np.ndarray) -> np.ndarray:
    """Rows in the order of the keys, the first `most` of each value of the first key."""
    order = np.lexsort(keys[::-1])
    run = keys[0][order]
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.empty(0, np.int64)
    place = np.arange(len(run)) - np.repeat(start, np.diff(np.r_[start, len(run)]))
    return order[place < most]


class Vectors:
    """A list column as matrices: rows by their dimension (-1 for null, or a null component), values, norms (1 for none)."""

    def __init__(self, column: pa.ChunkedArray):
        lists = pa.concat_arrays(column.chunks or [pa.array([], column.type)])
        flat = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(sizes) - sizes
        lacks = np.zeros(len(sizes), bool)
        lacks[np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        self.flat = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        self.dim = np.where(lacks | lists.is_null().to_numpy(zero_copy_only=False), -1, sizes)

    def of(self, rows: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values, norms, unit vectors, and which rows can't be judged by these: a component or the norm isn't a usual number."""
        v = self.flat[self.first[rows][:, None] + np.arange(dim)]
        with np.errstate(all="ignore"):
            squares = np.zeros(len(rows))
            for j in range(dim):
                squares += v[:, j] * v[:, j]
            norm = np.sqrt(squares)
            norm[norm == 0] = 1.0
            odd = ~np.isfinite(norm) | (norm < 1e-100)
            return v, norm, np.where(odd[:, None], 0.0, v / norm[:, None]), odd


def nearest_of_block(items: pa.Table, asked: pa.Table, most: int, within: tuple[str, ...], item_id: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries and of items, and their cosines: each query's best `most` of the block, of each value of `within`.

    Products of unit vectors leave what is within rounding of the `most`-th best; those cosines are then summed component by component.
    Of equal vectors only the `most` first ids can be wanted. A cosine that isn't known stands behind all others.
    """
    place, q, v = places(items.column(item_id)), Vectors(asked.column("_q")), Vectors(items.column("_v"))
    group = np.zeros(len(place), np.int64)
    for c in within:
        own = places(items.column(c))
        group = np.unique(group * (own.max(initial=0) + 1) + own, return_inverse=True)[1].ravel()
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for dim in np.unique(q.dim):
        queries = np.flatnonzero(q.dim == dim)
        for g in np.unique(group):
            same = np.flatnonzero((group == g) & (v.dim == dim)) if dim >= 0 else np.empty(0, np.int64)
            if len(same) < most:
                unknown = np.setdiff1d(np.flatnonzero(group == g), same)
                unknown = unknown[np.argsort(place[unknown], kind="stable")[:most]]
                out.append((np.repeat(queries, len(unknown)), np.tile(unknown, len(queries)), np.full(len(queries) * len(unknown), np.nan)))
            if not len(same):
                continue
            raw = np.ascontiguousarray(v.of(same, dim)[0])
            kind = np.unique(raw.view(f"V{8 * dim}").ravel(), return_inverse=True)[1].ravel() if dim else np.zeros(len(same), np.int64)
            same = same[np.sort(leading(most, kind, place[same]))]
            b, norm_b, unit_b, odd_b = v.of(same, dim)
            for at in range(0, len(queries), 256):
                some = queries[at : at + 256]
                a, norm_a, unit_a, odd_a = q.of(some, dim)
                product = unit_a @ unit_b.T
                product[odd_a], product[:, odd_b] = np.inf, np.inf
                if len(same) > most:
                    least = np.partition(product, len(same) - most, axis=1)[:, len(same) - most]
                    left, right = np.nonzero(product >= least[:, None] - ROUNDING)
                else:
                    left, right = (x.ravel() for x in np.indices(product.shape))
                cosine = np.zeros(len(left))
                with np.errstate(all="ignore"):
                    for j in range(dim):
                        cosine += a[left, j] * b[right, j]
                    cosine = cosine / norm_a[left] / norm_b[right]
                lost = np.isnan(cosine)
                best = leading(most, left, ~lost, -np.where(lost, 0.0, cosine), place[same[right]])
                # Not a number is more than any number, as Spark orders them; null is less. They are told apart by infinity here.
                out.append((some[left[best]], same[right[best]], np.where(lost, np.inf, cosine)[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def dense(queries: DataFrame, chunks: DataFrame, most: int, vector: str = "embedding", query_id: str = "query_id", item_id: str = "chunk_id", carry: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """Exact cosine of every query with every chunk, best `most` kept, of each value of the carried columns `within`. A stated query set against all rows.

    Blocks of queries meet blocks of chunks; only a block's best leave a task. A cosine with a vector of zeros is 0; one without a
    vector, with a null component or of different lengths is null.
    """
    blocks, parts = (max(1, -(-df.count() // each)) for df, each in ((chunks, VECTOR_BLOCK), (queries, QUERY_BLOCK)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    q = queries.select(query_id, F.col(vector).alias("_q"), dealt(parts, query_id, vector).alias("_part"), numbers(blocks).alias("_block"))
    v = chunks.select(item_id, *carry, F.col(vector).alias("_v"), dealt(blocks, item_id, vector).alias("_block"), numbers(parts).alias("_part"))
    fields = [T.StructField(f.name, f.dataType) for f in (queries.schema[query_id], *(chunks.schema[c] for c in (item_id, *carry)))]

    def nearest(items: pa.Table, asked: pa.Table) -> pa.Table:
        left, right, cosine = nearest_of_block(items, asked, most, within, item_id)
        known = pa.array(np.where(np.isinf(cosine), np.nan, cosine), mask=np.isnan(cosine), from_pandas=False)
        return pa.table({query_id: asked.column(query_id).take(pa.array(left)), **{c: items.column(c).take(pa.array(right)) for c in (item_id, *carry)}, "cosine": known})

    keys = ["_part", "_block"]
    scored = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(nearest, T.StructType([*fields, T.StructField("cosine", T.DoubleType())]))
    return ranked(scored, query_id, "cosine", item_id, most, list(within))


def per_program(queries: DataFrame, chunks: DataFrame, programs: list[str | int], most: int, program: str = "program") -> DataFrame:
    """A comparison's chunks: of each of the programs max(2, most // their number), place in the programs' order, then by rank.

    programs: the few that are compared, in order.
    """
    each = max(2, most // len(programs))
    found = dense(queries, chunks.where(F.col(program).isin(*programs)), each, carry=(program,), within=(program,))
    order = F.array_position(F.array(*map(F.lit, programs)), F.col(program)) - 1
    return found.withColumn("place", (order * each + F.col("rank")).cast("long"))


def abstained(found: DataFrame, floor: float = 0.58, query: str = "query_id", cosine: str = "cosine") -> DataFrame:
    """Each query's best cosine, and whether it is under the floor, so that nothing is answered."""
    best = found.groupBy(query).agg(F.max(cosine).alias("best_cosine"))
    return best.withColumn("abstains", F.col("best_cosine") < floor)


def terms(col: Column) -> Column:
    """Lower-case words of letters and digits of any script."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def keyword_best(chunks: pa.Table, sets: pa.Table, most: int, item_id: str) -> pa.Table:
    """_set, item, score: each word set's best `most` chunks of a block, of those that hold all its words.

    chunks: item, _len, _words; sets: _set. Words are joined by spaces. The block's postings are sorted once; a set walks its shortest list.
    """
    asked = [(s, s.split(" ")) for s in sets.column("_set").to_pylist()]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in asked for w in ws))}
    length = chunks.column("_len").to_numpy().astype(np.int64)
    # Rows of one id and length are one chunk; chunks are numbered in the order of their ids.
    key = places(chunks.column(item_id)) * (length.max(initial=0) + 1) + length
    _, sample, chunk = np.unique(key, return_index=True, return_inverse=True)
    chunk, n = chunk.ravel(), max(len(sample), 1)
    vocabulary, codes, counts = pa.array(list(number), pa.string()), [], []
    for at in range(0, chunks.num_rows, 1_000):
        words = pa.concat_arrays(pc.split_pattern(chunks.column("_words").slice(at, 1_000).cast(pa.string()), " ").chunks)
        known = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        holder = np.repeat(chunk[at : at + 1_000], pc.list_value_length(words).to_numpy())
        code, count = np.unique((known * n + holder)[known >= 0], return_counts=True)
        codes.append(code)
        counts.append(count)
    code, inverse = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_inverse=True)
    count = np.zeros(len(code), np.int64)
    np.add.at(count, inverse.ravel(), np.concatenate(counts) if counts else np.empty(0, np.int64))
    first, holders, size = np.searchsorted(code, np.arange(len(number) + 1) * n), code % n, length[sample]
    found, items, scores = [], [], []
    for s, words in asked:
        lists = sorted(((first[i + 1] - first[i], first[i], times) for i, times in ((number[w], words.count(w)) for w in dict.fromkeys(words))))
        if lists[0][0] == 0:
            continue
        held = holders[lists[0][1] : lists[0][1] + lists[0][0]]
        hits = count[lists[0][1] : lists[0][1] + lists[0][0]] * lists[0][2]
        for many, at, times in lists[1:]:
            other = holders[at : at + many]
            place = np.minimum(np.searchsorted(other, held), many - 1)
            both = other[place] == held
            held, hits = held[both], hits[both] + count[at + place[both]] * times
        score = hits / size[held]
        if len(score) > most:
            enough = score >= np.partition(score, len(score) - most)[len(score) - most]
            held, score = held[enough], score[enough]
        best = np.argsort(-score, kind="stable")[:most]
        found += [s] * len(best)
        items.append(sample[held[best]])
        scores.append(score[best])
    taken = pa.array(np.concatenate(items) if items else np.empty(0, np.int64))
    return pa.table({"_set": pa.array(found, pa.string()), item_id: chunks.column(item_id).take(taken), "score": np.concatenate(scores) if scores else np.empty(0)})


def keyword(queries: DataFrame, chunks: DataFrame, most: int, text: str = "content", query_id: str = "query_id", item_id: str = "chunk_id") -> DataFrame:
    """Chunks that hold all of a query's words, ranked by how often they occur in it over the chunk's length.

    Queries of the same words are one word set. Chunks are dealt in blocks by their bytes, each word set goes to each block, and only a
    block's best leave it, so pairs of a query and a chunk are never rows. Rows of one id and length are one chunk.
    """
    asked = queries.select(query_id, F.explode(F.array_distinct(terms(F.col("text")))).alias("_w")).groupBy(query_id).agg(F.array_join(F.array_sort(F.collect_list("_w")), " ").alias("_set"))
    sets = asked.select("_set").distinct()
    size = chunks.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks, parts = max(1, -(-size // TEXT_BLOCK)), max(1, -(-sets.count() // SET_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    words = chunks.where(F.col(text).isNotNull()).select(item_id, terms(F.col(text)).alias("_ws")).select(item_id, F.size("_ws").alias("_len"), F.array_join("_ws", " ").alias("_words"))
    dealt = words.where("_len > 0").select("*", F.pmod(F.xxhash64(item_id, "_len"), F.lit(blocks)).cast("int").alias("_block"), numbers(parts).alias("_part"))
    sent = sets.select("_set", F.pmod(F.xxhash64("_set"), F.lit(parts)).cast("int").alias("_part"), numbers(blocks).alias("_block"))
    schema = T.StructType([T.StructField("_set", T.StringType()), T.StructField(item_id, chunks.schema[item_id].dataType), T.StructField("score", T.DoubleType())])
    keys = ["_part", "_block"]
    found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(lambda c, s: keyword_best(c, s, most, item_id), schema)
    best = ranked(found, "_set", "score", item_id, most)
    return asked.join(best, "_set").select(query_id, item_id, "score", "rank")


def fused(legs: list[DataFrame], most: int, query_id: str = "query_id", item_id: str = "chunk_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of legs with columns query, item, rank (from 0)."""
    rows = legs[0].select(query_id, item_id, "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select(query_id, item_id, "rank"))
    scores = rows.groupBy(query_id, item_id).agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("rrf"))
    return ranked(scores, query_id, "rrf", item_id, most)


def retrieve(queries: DataFrame, chunks: DataFrame, most: int = 5, leg: int = 20, floor: float = 0.58, k: int = 60) -> DataFrame:
    """Both legs fused; queries whose best cosine is under the floor abstain and get no rows."""
    d, w = dense(queries, chunks, leg), keyword(queries, chunks, leg)
    best = d.groupBy("query_id").agg(F.max("cosine").alias("best_cosine")).where(F.col("best_cosine") >= floor)
    return fused([d, w], most, k=k).join(best, "query_id")


def servable(chunks: DataFrame, sources: DataFrame, channel: str) -> DataFrame:
    """Chunks of allowed sources, internal ones for the internal channel only. sources: doc_id, a list kept by hand, trimmed here."""
    allowed = sources.select(F.trim("doc_id").alias("doc_id")).distinct()
    own = chunks.join(allowed, "doc_id", "left_semi")
    return own if channel == "internal" else own.where(~F.col("access_tier").eqNullSafe("internal"))


def citations(found: DataFrame, query: str, rank: str, ref: str = "ref", score: str = "score") -> DataFrame:
    """Found chunks as citations: query and a struct of n (from 1, by rank), corpus, ref, snippet, doc_id, section, page, score, access_tier.

    The page is the one that the reference names, null without one; the score has four decimals, null stays null.
    """
    n = F.row_number().over(Window.partitionBy(query).orderBy(rank, "chunk_id"))
    shown = F.coalesce(ref, F.lit(""))
    fields = [F.col("n"), F.col("corpus"), shown.alias("ref"), F.coalesce("content", F.lit("")).alias("snippet"), F.col("doc_id"), F.col("section"), page_of(shown).alias("page"), F.round(score, 4).alias("score"), F.col("access_tier")]
    return found.withColumn("n", n).select(query, F.struct(*fields).alias("citation"))
