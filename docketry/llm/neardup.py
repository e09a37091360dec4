"""MinHash near-dedup: signature coordinates post documents, rare coordinates pick candidates, full sets confirm links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import map_arrow, parts_for, perhaps_among, written
from docketry.llm.components import attached, components

GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Word hashes that a Python worker keeps between texts; the table is emptied when it gets larger.
KEPT_WORDS = 1_000_000
#: Pairs of one bucket where nearly all classes of a group are compared.
GRID_PAIRS = 8_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORD_HASHES = WordHashes()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all words if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    x = np.zeros(n, np.uint64)
    for i in range(width):
        x = x * GOLDEN + mixed(hashes[i : i + n])
    return np.unique(mixed(x))


def signature(shingles: np.ndarray, coordinates: int, seed: int = 1) -> np.ndarray:
    """A 64-bit key for each coordinate, made of the coordinate's number and the least hash."""
    factors = np.random.default_rng(seed).integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(coordinates, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None] * factors
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    return mixed(least + GOLDEN * np.arange(1, coordinates + 1, dtype=np.uint64)).view(np.int64)


def columns(table: pa.Table, name: str, width: int) -> np.ndarray:
    """A list column of fixed width as a matrix, a row for each row of the table."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def collisions(table: pa.Table, classes: pa.Table, coordinates: int, matches: int, percent: int) -> pa.Table:
    """Pairs a, b of a bucket: of rows of one posting list and two blocks of it, those with at least `matches` equal coordinates.

    Rows: key, i, j (the list and the blocks that meet), part (the row's own block), id, component; classes: id, n, keys and front
    (the keys that the class is posted under), once for all lists of the bucket. Pairs that are known to be of one component are passed over, as are pairs whose
    sizes rule the similarity out. A pair that meets in several lists is counted in the first of them only.
    """
    where = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
    _, meeting = np.unique(where, axis=0, return_inverse=True)
    meeting = meeting.ravel()
    part, ids, comp = (table.column(c).to_numpy() for c in ("part", "id", "component"))
    own_keys, fronts = columns(classes, "keys", coordinates), classes.column("front").to_pylist()
    own_posted = np.array([np.isin(k, f) for k, f in zip(own_keys, fronts, strict=True)])
    known = classes.column("id").to_numpy()
    by_id = np.argsort(known)
    at_class = by_id[np.searchsorted(known, ids, sorter=by_id)]
    n, keys, posted = classes.column("n").to_numpy()[at_class], own_keys[at_class], own_posted[at_class]
    order = np.argsort(meeting, kind="stable")
    a, b = [], []
    for own in np.split(order, np.flatnonzero(np.diff(meeting[order])) + 1):
        key, i, j = where[own[0]]
        left, right = (own, own) if i == j else (own[part[own] == i], own[part[own] == j])
        size_l, size_r = n[left][:, None], n[right][None, :]
        open_ = (comp[left][:, None] != comp[right][None, :]) & (percent * np.maximum(size_l, size_r) <= 100 * np.minimum(size_l, size_r))
        if i == j:
            open_ = np.triu(open_, 1)
        p, q = np.nonzero(open_)
        for at in range(0, len(p), 100_000):
            x, y = left[p[at : at + 100_000]], right[q[at : at + 100_000]]
            equal = keys[x] == keys[y]
            enough = equal.sum(1) >= matches
            x, y, equal = x[enough], y[enough], equal[enough]
            first = (equal & posted[x] & posted[y]).argmax(1)
            here = keys[x, first] == key
            a.append(ids[x[here]])
            b.append(ids[y[here]])
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    width: int = 5,
    coordinates: int = 48,
    matches: int = 25,
    block: int = 256,
    rounds: int = 2,
    with_hash: bool = False,
) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id (smallest linked id, itself included), kept (is that id).

    with_hash: also text_hash, the text's xxhash64, to find the row again where ids are null or repeated.

    Documents are linked when the Jaccard similarity of their distinct word shingles is at least percent / 100. Candidates
    agree in at least `matches` of `coordinates` MinHash values; a pair at exactly 0.80 fails 25 with a chance of 3 in
    1,000,000, one at 0.85 fails 30 with a chance of 3 in 100,000. Texts without words are linked with nothing, repeated rows and equal sets share a component. A null id takes
    no part as smallest id: its component is that of its set's other holders, or null, and then it is kept. Ids are whole
    numbers. Other columns are ignored.

    Equal sets are one class first, so copies never meet as pairs. Each class is posted under its coordinates' keys, and
    its posting lists are merged shortest first: a partner with enough matches must stand in one of the
    coordinates - matches + 1 shortest (its prefix; keys of its own count as the shortest, so classes without enough shared
    keys drop out), and the longer lists are skipped, as the matches of a pair are counted on the two signatures. Pairs of at
    least `matches` equal coordinates meet with their full sets.

    So that a large group of near copies isn't compared pair by pair, each of `rounds` rounds compares all members of a
    list with one of them, its pivot; what links is one component, and only pairs of different components are left. After
    that the lists that still hold several components are cut in blocks of about `block` classes, and all pairs of
    different components are counted, block by block; only pairs with enough matches leave a task. Nothing is left out:
    a pair that is never compared is of one component by other links. Texts of candidates alone are shuffled. Tables between the
    steps are in the shared folder.
    """

    def signed(batch: pa.RecordBatch) -> pa.Table:
        n, c1, c2, keys = [], [], [], []
        with np.errstate(over="ignore"):
            for t in batch.column("_text").to_pylist():
                s = shingle_set(t, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                c1.append(int.from_bytes(d[:8], "big", signed=True))
                c2.append(int.from_bytes(d[8:], "big", signed=True))
                keys.append(signature(s, coordinates) if len(s) else None)
        out = {"id": batch.column("_id"), "h": batch.column("_h"), **{k: pa.array(v, pa.int64()) for k, v in (("n", n), ("c1", c1), ("c2", c2))}}
        return pa.table(out | {"keys": pa.array(keys, pa.list_(pa.int64()))})

    def with_sets(batch: pa.RecordBatch) -> pa.Table:
        with np.errstate(over="ignore"):
            sets = [shingle_set(t, width) for t in batch.column("_text").to_pylist()]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        c1 = batch.column("c1").to_pylist()
        own = [i for i, d in enumerate(digests) if int.from_bytes(d[:8], "big", signed=True) == c1[i]]
        return pa.table({"id": pa.array([c1[i] for i in own], pa.int64()), "shingles": pa.array([sets[i].tobytes() for i in own], pa.binary())})

    def met(pairs: DataFrame, payload: DataFrame, agree: Callable[[pa.Table, pa.Table], np.ndarray]) -> DataFrame:
        """The pairs whose payloads agree. Pairs are dealt in buckets; a class with very many pairs is in many buckets."""
        pairs = written(pairs, "pairs")
        n = pairs.count()
        salt = F.pmod(F.xxhash64("b"), F.lit(16 + n // 10_000))
        dealt = pairs.withColumn("bucket", F.pmod(F.xxhash64("a", salt), F.lit(parts_for(n, 2_000))))
        # Under names of their own: both sides come from the same tables.
        own_names = lambda df, **names: df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns))
        members = dealt.join(own_names(payload, id="b"), "b")
        pivots = own_names(dealt.select("a", "bucket").distinct()).join(own_names(payload, id="a"), "a")

        def kept(left: pa.Table, right: pa.Table) -> pa.Table:
            place = {x: i for i, x in enumerate(right.column("a").to_pylist())}
            right = right.take(pa.array([place[x] for x in left.column("a").to_pylist()], pa.int64()))
            return left.select(["a", "b"]).filter(pa.array(agree(left, right), pa.bool_()))

        return written(members.groupBy("bucket").cogroup(pivots.groupBy("bucket")).applyInArrow(kept, "a long, b long"), "met")

    def met_in_grid(pairs: DataFrame, payload: DataFrame, agree: Callable[[pa.Table, pa.Table], np.ndarray]) -> DataFrame:
        """As `met`, for pairs of classes that nearly all pair with one another: classes are dealt in chunks, pairs by their two chunks.

        A payload is sent once to every pair of chunks that asks for it, of which there are about n / GRID_PAIRS in all, instead of once for every pair.
        """
        pairs = written(pairs, "pairs")
        side = max(1, int(np.ceil(np.sqrt(pairs.count() / GRID_PAIRS))))
        chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        dealt = pairs.withColumn("bucket", F.least(chunk("a"), chunk("b")) * side + F.greatest(chunk("a"), chunk("b")))
        asked = dealt.select("bucket", F.col("a").alias("id")).union(dealt.select("bucket", F.col("b").alias("id"))).distinct()
        # Under names of their own: both sides of the next step come from the same pairs.
        renamed = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))
        carried = renamed(asked).join(renamed(payload), "id")

        def kept(left: pa.Table, right: pa.Table) -> pa.Table:
            ids = right.column("id").to_numpy()
            order = np.argsort(ids)
            out = []
            for at in range(0, left.num_rows, 4_000):
                some = left.slice(at, 4_000).select(["a", "b"])
                a, b = (order[np.searchsorted(ids, some.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))
                out.append(some.filter(pa.array(agree(right.take(pa.array(a)), right.take(pa.array(b))), pa.bool_())))
            return pa.concat_tables(out)

        return written(dealt.groupBy("bucket").cogroup(carried.groupBy("bucket")).applyInArrow(kept, "a long, b long"), "met")

    def many_matches(left: pa.Table, right: pa.Table) -> np.ndarray:
        x, y = (t.column("n").to_numpy() for t in (left, right))
        of_sizes = percent * np.maximum(x, y) <= 100 * np.minimum(x, y)
        return of_sizes & ((columns(left, "keys", coordinates) == columns(right, "keys", coordinates)).sum(1) >= matches)

    def similar(left: pa.Table, right: pa.Table) -> np.ndarray:
        found = np.zeros(left.num_rows, bool)
        for i, (x, y) in enumerate(zip(left.column("shingles"), right.column("shingles"), strict=True)):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            found[i] = 100 * both >= percent * (len(x) + len(y) - both)
        return found

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signatures = written(map_arrow(own.withColumn("_h", F.xxhash64("_text")), signed, "id long, h long, n long, c1 long, c2 long, keys array<long>"), "signatures")
    holders = signatures.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = written(holders.groupBy("c1", "c2").agg(F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("keys").alias("keys")).withColumn("id", F.col("c1")), "classes")

    # Post; keep the keys that several classes share; of each class keep its rarest keys.
    posts = classes.select("id", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    listed = posts.join(shared, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("own"))
    room = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("own"))
    fronts = written(listed.where(room > 0).select("id", F.transform(F.slice("own", 1, room), lambda x: x["key"]).alias("front")), "fronts")
    posted = fronts.select("id", F.explode("front").alias("key"))

    # Signatures and texts of candidates alone are shuffled. They may be most documents, so these joins are always by a shuffle, whatever a small input's sizes suggest.
    n_fronts = fronts.count()
    candidates = written(perhaps_among(classes.select("id", "least_id", "n", "keys"), "id", fronts.select("id"), n_fronts).join(fronts.hint("merge"), "id"), "candidates")
    wanted = candidates.select(F.col("id").alias("c1"), F.col("least_id").alias("_id"))
    texts = perhaps_among(own, "_id", wanted.select("_id"), n_fronts).join(wanted.hint("merge"), "_id")
    sets = written(map_arrow(texts, with_sets, "id long, shingles binary"), "sets")
    signed_keys = candidates.select("id", "n", "keys")

    def labelled(found: DataFrame | None, by: Column) -> tuple[DataFrame, DataFrame]:
        """Components so far, and the lists that hold several of them: key, id, component, the list's pivot, least by `by`."""
        label, joined = posted.withColumn("component", F.col("id")), None
        if found is not None:
            joined = components(found)
            label = posted.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("root", "id").alias("component"))
        rows = written(label, "posted")
        open_ = attached(rows, "key", F.col("id"), rows.count(), pivot=F.struct(by.alias("o"), F.col("id"), F.col("component")), low=F.col("component"), high=-F.col("component"))
        return joined, open_.where(F.col("low") != -F.col("high"))

    def links(new: DataFrame) -> DataFrame:
        """New links beside the components so far, each node's link with its root."""
        return new if joined is None else new.union(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))

    joined, lists = labelled(None, F.xxhash64("id"))
    for k in range(1, max(1, rounds) + 1):
        pairs = lists.where(F.col("component") != F.col("pivot.component")).select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b"))
        starred = met(met(pairs.distinct(), signed_keys, many_matches), sets, similar)
        joined, lists = labelled(links(starred), F.xxhash64("id", F.lit(k)))
        left_over = written(lists, "left-over")
        lists, n_left = left_over, left_over.count()
        if n_left == 0:
            break
    if n_left:
        # Lists of one group hold nearly the same classes and have the same pivot: their blocks meet in one bucket, where a signature is sent once.
        placed = attached(left_over.select("key", "id", "component"), "key", F.col("id"), n_left, size="m", head=F.xxhash64("id")).withColumn("parts", F.ceil(F.col("m") / block).cast("long"))
        placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        spread = placed.select("key", "id", "component", "part", "parts", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        i, j = F.least("part", "other"), F.greatest("part", "other")
        group = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(parts_for(n_left, 2_000)))).otherwise(F.xxhash64("head", "parts", i, j))
        meets = written(spread.select("key", "id", "component", "part", i.alias("i"), j.alias("j"), group.alias("bucket")), "meets")
        asked = meets.select("bucket", "id").distinct().join(candidates.select(*(F.col(c).alias(c) for c in ("id", "n", "keys", "front"))), "id")
        asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))
        counted = meets.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(lambda t, c: collisions(t, c, coordinates, matches, percent), "a long, b long")
        rest = met_in_grid(counted, sets, similar)
        if rest.count():
            joined = components(links(rest))

    # A component is named by its least class; what is wanted is its least id.
    rooted = classes.select("c1", "c2", "id", "least_id").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    of_class = attached(rooted, "root", F.col("id"), rooted.count(), component=F.col("least_id")).select("c1", "c2", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return (
        signatures.select("id", "h", "n", "c1", "c2")
        .join(of_class, ["c1", "c2"], "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), *([F.col("h").alias("text_hash")] if with_hash else []))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
