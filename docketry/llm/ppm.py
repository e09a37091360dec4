"""LM scoring by prediction by partial matching: a byte-context trie over the running text, escape estimates and symbol exclusion.

The trie is a table for each order k: a row is a node's context of k bytes with one symbol after it, packed in a whole
number, and the symbol's count. Counting goes from the longest order down, chances go from order 0 up, one join of a
context with its own shorter form at a time. No key of these joins and windows has more than 256 rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import parts_for, slices, text_bytes, written

#: Context and symbol must fit a positive 64-bit number.
MAX_ORDER = 6
#: Stands before every text as often as the order is long, and the symbol that ends it: a byte that UTF-8 never uses.
START, END = b"\n", b"\xff"
SYMBOLS = 256
#: Grams that a task gathers before it sums equal ones, bytes of text that are taken at a time, and rows of a batch sent on.
GATHER, PIECE, BATCH = 800_000, 250_000, 100_000
#: Words or grams of a shard of the model, and blocks that meet one copy of it.
SHARD, MEET = 200_000, 64
WORD, GRAM = 0, 1
#: Contexts with as many distinct symbols or more share their escape estimates.
MOST_DISTINCT = 20


def words(text: str | None) -> list[bytes]:
    """Words between space characters, A-Z lower-cased, and the end, which is no word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def grams(texts: list[str | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every byte of every text, A-Z lower-cased, and its end: the byte with its context above it, and its text's number.

    About PIECE bytes at a time; a longer text comes in several pieces, each with the bytes before it as context.
    """
    parts, owners, sizes, size = [], [], [], 0
    for i, t in enumerate(texts):
        whole = START * order + (t or "").encode("utf-8", "surrogatepass").lower() + END
        for at in range(order, len(whole), PIECE):
            parts.append(whole[at - order : at + PIECE])
            owners.append(i)
            sizes.append(len(parts[-1]))
            size += sizes[-1]
            if size >= PIECE:
                yield packed(parts, owners, sizes, order)
                parts, owners, sizes, size = [], [], [], 0
    if parts:
        yield packed(parts, owners, sizes, order)


def packed(parts: list[bytes], owners: list[int], sizes: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    gram = b[order:].copy()
    for k in range(1, order + 1):
        gram |= b[order - k : len(b) - k] << (8 * k)
    # The first `order` bytes of each part are context only.
    size = np.array(sizes)
    place = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size)
    own = place[order:] >= order
    return gram[own], np.repeat(np.array(owners), size)[order:][own]


def summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and the sums of their counts."""
    code, distinct = pd.factorize(gram)
    return distinct, np.bincount(code, n, len(distinct)).astype(np.int64)


def gram_counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Grams of all texts with their uses, none for held-out ones; a task's equal ones are summed as long as that saves half."""

    def rows(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(gram), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(gram[at : at + BATCH]), pa.array(n[at : at + BATCH])], ["gram", "n"])

    gathered, size = [], 0
    for batch in slices(batches):
        learnt = 1 - np.array(batch.column("_held").to_pylist(), np.int64)
        for gram, owner in grams(batch.column("_text").to_pylist(), order):
            gathered.append(summed(gram, learnt[owner]))
            size += len(gathered[-1][0])
            if size >= GATHER:
                gathered = [summed(*map(np.concatenate, zip(*gathered, strict=True)))]
                size = len(gathered[0][0])
                if size > GATHER // 2:
                    yield from rows(*gathered[0])
                    gathered, size = [], 0
    if gathered:
        yield from rows(*summed(*map(np.concatenate, zip(*gathered, strict=True))))


def gaps(gram: np.ndarray) -> bytes:
    """Sorted grams as the differences between them, which are small and compress well."""
    return np.diff(gram, prepend=0).tobytes()


def ungapped(keys: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(keys, np.int64))


def cut(order: int) -> int:
    """Keeps a gram's symbol and the latest `order` bytes of its context."""
    return (1 << (8 * (order + 1))) - 1


def bucket(total: Column, distinct: Column) -> tuple[Column, Column]:
    """Contexts of like totals and of like numbers of distinct symbols share their escape estimate."""
    return F.when(total < 8, total).otherwise(F.length(F.bin(total)) + 4).cast("int"), F.least(distinct, F.lit(MOST_DISTINCT)).cast("int")


def nodes(trie: DataFrame, order: int) -> list[DataFrame]:
    """For every order: gram, n (uses), total and distinct (of its context). Grams that training never used have n = 0.

    The longest order counts every use; a shorter one counts each longer context that saw the symbol once, as a trie does
    that stops its updates where the symbol is known.
    """
    levels: list[DataFrame] = []
    cells = trie
    for k in range(order, -1, -1):
        context = F.shiftright("gram", 8).alias("context")
        own = cells.select(context, "gram", "n").repartition("context").groupBy("context", "gram").agg(F.sum("n").alias("n"))
        same = Window.partitionBy("context")
        level = written(own.select("gram", "n", F.sum("n").over(same).alias("total"), F.sum((F.col("n") > 0).cast("long")).over(same).alias("distinct")), f"order-{k}")
        levels.append(level)
        cells = level.select(F.col("gram").bitwiseAND(F.lit(cut(max(k - 1, 0)))).alias("gram"), (F.col("n") > 0).cast("long").alias("n"))
    return levels[::-1]


def escape_estimates(levels: list[DataFrame]) -> list[tuple[int, int, int, float, float]]:
    """(order, bucket of totals, of distinct symbols, escapes, uses), each use of every context judged as if it were left out.

    A use is an escape if its symbol has no other use in that context; what is left is the context that would have met it.
    At most some 10,000 rows, whatever the input's size.
    """
    found = []
    for k, level in enumerate(levels):
        single = F.col("n") == 1
        size, kinds = bucket(F.col("total") - 1, F.col("distinct") - single.cast("long"))
        used = level.where("n > 0").select(F.lit(k).alias("k"), size.alias("t"), kinds.alias("d"), single.cast("long").alias("e"), "n")
        found.append(used.groupBy("k", "t", "d").agg(F.sum("e").cast("double").alias("e"), F.sum("n").cast("double").alias("a")))
    return [tuple(r) for r in reduce(DataFrame.unionAll, found).collect()]


def chances(levels: list[DataFrame]) -> DataFrame:
    """gram and chance, the natural logarithm of its symbol's probability after its context, of all grams of the longest order.

    A context that was never seen is passed over. One that has seen the symbol gives it its share of what is left when
    symbols that the longer contexts know are excluded, times the chance of no escape; else the escape is paid and the
    context one byte shorter is asked. Below order 0 all bytes that were never seen are alike. An escape's chance in a
    context of `total` uses and `distinct` symbols is the left-out estimate of its bucket, which half a use of each
    distinct symbol (method D) stands in for with the weight of two uses.
    """
    spark = levels[0].sparkSession
    estimates = spark.createDataFrame(escape_estimates(levels), "_k int, _t int, _d int, _e double, _a double")
    out = None
    for k, level in enumerate(levels):
        size, kinds = bucket(F.col("total"), F.col("distinct"))
        known = F.broadcast(estimates.where(F.col("_k") == k).drop("_k"))
        escape = (F.coalesce("_e", F.lit(0.0)) + F.col("distinct") / F.col("total")) / (F.coalesce("_a", F.lit(0.0)) + 2)
        here = level.withColumns({"_size": size, "_kinds": kinds}).join(known, (F.col("_size") == F.col("_t")) & (F.col("_kinds") == F.col("_d")), "left")
        here = here.select("gram", "n", "total", F.when(F.col("total") > 0, escape).otherwise(1.0).alias("escape"), "distinct")
        if out is None:
            # lower: the chance after an escape from this context, what it has seen excluded.
            out = here.withColumn("lower", 1 / F.greatest(F.lit(SYMBOLS) - F.col("distinct"), F.lit(1)))
        else:
            shorter = out.select(F.col("gram").alias("_suffix"), *(F.col(c).alias(f"_{c}") for c in ("n", "total", "escape", "lower")))
            met = here.withColumn("_short", F.col("gram").bitwiseAND(F.lit(cut(k - 1)))).join(shorter, F.col("_short") == F.col("_suffix"))
            known_there = F.sum(F.when(F.col("n") > 0, F.col("_n")).otherwise(0)).over(Window.partitionBy(F.shiftright("gram", 8)))
            left = F.col("_left")
            lower = F.when(left <= 0, F.col("_lower")).when(F.col("_n") > 0, (1 - F.col("_escape")) * F.col("_n") / left).otherwise(F.col("_escape") * F.col("_lower"))
            out = met.withColumn("_left", F.col("_total") - known_there).select("gram", "n", "total", "escape", lower.alias("lower"))
    chance = F.when(F.col("n") > 0, (1 - F.col("escape")) * F.col("n") / F.col("total")).otherwise(F.col("escape") * F.col("lower"))
    return out.select("gram", F.log(chance).alias("chance"))


def score(
    docs: DataFrame,
    held_out: Callable[[Column], Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 5,
    block_bytes: int = 12_000_000,
) -> DataFrame:
    """One row for each document row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    held_out: a condition on the id; its rows are scored but never learnt from. Words stand between space characters, A-Z
    lower-cased; a text's tokens are its words and an end. base_score is an add-one unigram model of whole tokens. score is
    the log10 probability of all bytes of the text, A-Z lower-cased, and its end, by a pretrained trie of byte contexts
    of at most `order` bytes (6 at most), which run over spaces and line ends: PPM with escape estimates and symbol
    exclusion (`chances`). The base names every unknown word at the price of one of V + 1, however long; the trie spells it.

    A null text counts as an empty one: its end alone. Null ids are learnt from. Without training rows the base gives 1
    to every token and the trie 1/256 to every byte. Repeated rows are learnt from and scored one by one; other columns are
    ignored; an empty table gives no rows.

    Everything grows with the input and is dealt out by keys of bounded size: words by word, nodes by context (`nodes`).
    Only the escape estimates, a table of bounded size, come to the driver. A task sums its equal grams before they are
    shuffled. A block of about block_bytes of documents asks shards of the model for its distinct words and grams, so
    frequent ones weigh no more than rare ones; shards are copied as the blocks grow in number. Texts are shuffled once. Steps that others read again are tables in the shared folder.
    """
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"order must be 1 to {MAX_ORDER}")
    held = F.coalesce(held_out(F.col(id_col)), F.lit(False)) if held_out else F.lit(False)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held.alias("_held"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, other = Counter(), set()

        def rows() -> pa.RecordBatch:
            found = [*learnt, *other.difference(learnt)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([learnt.get(w, 0) for w in found], pa.int64())], ["word", "c"])

        for batch in slices(batches):
            for t, h in zip(batch.column("_text").to_pylist(), batch.column("_held").to_pylist(), strict=True):
                (other if h else learnt).update(words(t))
            if len(learnt) + len(other) > SHARD:
                yield rows()
                learnt.clear()
                other.clear()
        yield rows()

    vocabulary = written(own.mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count_if(F.col("c") > 0).alias("distinct"), F.count("*").alias("words")).first()
    n_train, base_of = sums["tokens"], np.log10(sums["tokens"] + sums["distinct"] + 1)
    trie = own.mapInArrow(lambda batches: gram_counts(batches, order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    levels = nodes(trie, order)
    chance = chances(levels)

    def packed_words(shard: pa.Table) -> pa.Table:
        return pa.table({"kind": pa.array([WORD], pa.int32()), "shard": shard.column("shard")[:1], "keys": [b"\n".join(shard.column("word").to_pylist())], "numbers": [shard.column("c").to_numpy().tobytes()]})

    def packed_grams(shard: pa.Table) -> pa.Table:
        gram = shard.column("gram").to_numpy()
        by = np.argsort(gram)
        return pa.table({"kind": pa.array([GRAM], pa.int32()), "shard": shard.column("shard")[:1], "keys": [gaps(gram[by])], "numbers": [shard.column("chance").to_numpy()[by].tobytes()]})

    def block_keys(texts: pa.Table) -> pa.Table:
        """A block's distinct words and grams, a row for each shard that may hold them."""
        all_texts = texts.column("_text").to_pylist()
        found: dict[int, list[bytes]] = {}
        for w in set().union(*map(words, all_texts)):
            found.setdefault(zlib.crc32(w) % word_shards, []).append(w)
        rows = [(WORD, shard, b"\n".join(own)) for shard, own in found.items()]
        gathered, size = [np.empty(0, np.int64)], 0
        for gram, _ in grams(all_texts, order):
            gathered.append(pd.unique(gram))
            size += len(gathered[-1])
            if size >= 2 * GATHER:
                gathered, size = [pd.unique(np.concatenate(gathered))], 0
        distinct = np.sort(pd.unique(np.concatenate(gathered)))
        for shard in range(gram_shards):
            rows.append((GRAM, shard, gaps(distinct[distinct % gram_shards == shard])))
        kinds, shards, keys = zip(*rows, strict=True)
        block = [texts.column("block")[0].as_py()] * len(rows)
        return pa.table({"block": pa.array(block, pa.int64()), "kind": pa.array(kinds, pa.int32()), "shard": pa.array(shards, pa.int64()), "keys": pa.array(keys, pa.binary())})

    def answers(asked: pa.Table, model: pa.Table) -> pa.Table:
        """The model's numbers for each block's words or grams, in the order asked; every one of them is in the model."""
        blocks, all_keys, numbers = asked.column("block"), asked.column("keys"), []
        if asked.num_rows:
            keys, values = model.column("keys")[0].as_py(), model.column("numbers")[0].as_py()
            if asked.column("kind")[0].as_py() == WORD:
                count = dict(zip(keys.split(b"\n"), np.frombuffer(values, np.int64).tolist(), strict=True))
                numbers = [np.fromiter(map(count.__getitem__, own.as_py().split(b"\n")), np.int64).tobytes() for own in all_keys]
            else:
                gram, chance = ungapped(keys), np.frombuffer(values, np.float64)
                numbers = [chance[np.searchsorted(gram, ungapped(own.as_py()))].tobytes() for own in all_keys]
        return pa.table({"block": blocks, "kind": asked.column("kind"), "keys": all_keys, "numbers": pa.array(numbers, pa.binary())})

    # A block's distinct words and grams and the block itself come from the same shuffle.
    n_blocks = parts_for(text_bytes(own, "_text"), block_bytes)
    placed = own.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks)).alias("block"), "*")
    word_shards, gram_shards = parts_for(sums["words"], SHARD), parts_for(levels[-1].count(), SHARD)
    packed_shard = "kind int, shard long, keys binary, numbers binary"
    of_words = vocabulary.withColumn("shard", F.crc32("word") % F.lit(word_shards)).groupBy("shard").applyInArrow(packed_words, packed_shard)
    of_grams = chance.withColumn("shard", F.col("gram") % F.lit(gram_shards)).groupBy("shard").applyInArrow(packed_grams, packed_shard)
    # A shard is copied for every MEET blocks, so what meets in one task is bounded however many blocks there are.
    copies = parts_for(n_blocks, MEET)
    model = of_words.union(of_grams).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    asked = placed.groupBy("block").applyInArrow(block_keys, "block long, kind int, shard long, keys binary").withColumn("copy", F.pmod("block", F.lit(copies)))
    by = ("kind", "shard", "copy")
    needed = asked.groupBy(*by).cogroup(model.groupBy(*by)).applyInArrow(answers, "block long, kind int, keys binary, numbers binary")

    def doc_scores(texts: pa.Table, known: pa.Table) -> pa.Table:
        number, counts, all_grams, all_chances = {}, [], [np.empty(0, np.int64)], [np.empty(0)]
        for kind, keys, numbers in zip(*(known.column(c).to_pylist() for c in ("kind", "keys", "numbers")), strict=True):
            if kind == WORD:
                own = keys.split(b"\n")
                number.update(zip(own, range(len(number), len(number) + len(own)), strict=True))
                counts.append(np.frombuffer(numbers, np.int64))
            else:
                all_grams.append(ungapped(keys))
                all_chances.append(np.frombuffer(numbers, np.float64))
        c = np.concatenate(counts) if counts else np.empty(0, np.int64)
        base = np.log10(c + 1) - base_of
        place, value = pd.Index(np.concatenate(all_grams)), np.concatenate(all_chances)
        all_texts = texts.column("_text").to_pylist()
        total, n_bytes = np.zeros(len(all_texts)), np.zeros(len(all_texts), np.int64)
        for gram, owner in grams(all_texts, order):
            code, distinct = pd.factorize(gram)
            first, last = owner[0], owner[-1] + 1
            total[first:last] += np.bincount(owner - first, value[place.get_indexer(distinct)][code], last - first)
            n_bytes[first:last] += np.bincount(owner - first, minlength=last - first)
        rows = []
        for t in all_texts:
            at = np.fromiter(map(number.__getitem__, words(t)), np.int64)
            rows.append((len(at), int((c[at] > 0).sum()), float(base[at].sum())))
        n, k, b = zip(*rows, strict=True) if rows else ((),) * 3
        return pa.table(
            {
                id_col: texts.column("_id"),
                "held_out": texts.column("_held"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(k, pa.int64()),
                "train_tokens": pa.array([n_train] * len(n), pa.int64()),
                "base_score": pa.array(b, pa.float64()),
                "score": pa.array(total / np.log(10), pa.float64()),
                "n_bytes": pa.array(n_bytes - 1, pa.int64()),
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return placed.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(
        doc_scores, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    )
