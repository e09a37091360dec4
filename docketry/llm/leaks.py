"""Benchmark decontamination by a prefix-filtered containment join. DataFrame functions only on the main path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import ascii_lower, bounded_broadcast, parts_for, written

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the benchmark's vocabulary or windows that are sent to every executor at a time. A larger vocabulary is joined
#: by a shuffle; more windows are met in several passes over the documents, each with its own part of them.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; no words for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NO_WORD), ""), F.array().cast("array<string>"))


def rarity(docs: DataFrame, items: DataFrame, text_col: str, broadcast_rows: int) -> DataFrame:
    """How often every benchmark word occurs in all documents."""
    vocabulary = items.select(F.explode("_item").alias("_w")).distinct()
    wanted = bounded_broadcast(vocabulary, vocabulary.count(), broadcast_rows)
    found = docs.select(F.explode(words(F.col(text_col))).alias("_w")).join(wanted, "_w", "left_semi")
    return found.groupBy("_w").agg(F.count("*").alias("_n"))


def anchored_windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Every window of every item with its rarest word (_w) and that word's place in the window (_a).

    The rarest word is the necessary prefix of the window's words in order of rarity: a window of L words that must occur
    whole needs an overlap of L, so its prefix is one word long.
    """
    placed = items.select("_key", F.posexplode("_item").alias("_pos", "_w")).join(counts, "_w", "left")
    ranked = placed.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_n", F.lit(0)).alias("_n"), "_w"))).alias("_placed")
    )
    length = F.least(F.lit(window), F.size("_placed"))
    starts = F.explode(F.sequence(F.lit(0), F.size("_placed") - length)).alias("_s")
    cut = ranked.select("_key", "_placed", length.alias("_len"), starts).select("_key", "_s", F.slice("_placed", F.col("_s") + 1, F.col("_len")).alias("_cut"))
    rarest = F.array_min(F.transform("_cut", lambda x: F.struct(x["_n"].alias("n"), x["_w"].alias("w"), x["_pos"].alias("p"))))
    return cut.withColumn("_r", rarest).select(
        "_key", F.col("_r.w").alias("_w"), (F.col("_r.p") - F.col("_s")).alias("_a"), F.transform("_cut", lambda x: x["_w"]).alias("_window")
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    broadcast_rows: int = BROADCAST_ROWS,
    with_hash: bool = False,
) -> DataFrame:
    """One row for each document row: id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated.

    with_hash: also text_hash, the text's xxhash64, to find the row again where ids are null or repeated.

    A window is `window` consecutive item words; an item of fewer words, but not none, is one window. A document word in
    any occurrence of a window is hit. Document words meet the windows by an equi-join on each window's rarest word; its
    place in the window fixes where the window would lie in the document, the document's ends bound it, and it is compared
    whole. Texts stay where they are read and are met in one pass: only matches and (id, digest, n_words) are shuffled. At most `broadcast_rows`
    windows, as counted, are sent to the executors at a time.

    Null and empty texts have no words and no hits, in documents as in items; null item ids are dropped from the list but
    their windows count. Repeated rows give equal rows each (a row is known by id and text). An empty table on either
    side gives no hits. Other columns are ignored.
    """
    items = benchmark.select(
        F.struct(F.col(item_id_col).cast("string").alias("id"), F.xxhash64(item_text_col).alias("h")).alias("_key"), words(F.col(item_text_col)).alias("_item")
    ).where(F.size("_item") > 0).dropDuplicates(["_key"])
    index = written(anchored_windows(items, rarity(docs, items, text_col, broadcast_rows), window), "windows")
    parts = parts_for(index.count(), broadcast_rows)

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # An empty word after the last one meets a window of its own: so every document leaves one row, with its number of words.
    spread = own.select("_id", F.xxhash64("_text").alias("_h"), F.array_append(words(F.col("_text")), F.lit("")).alias("_words"))
    spread = spread.select("_id", "_h", "_words", F.posexplode("_words").alias("_p", "_v"))
    ends = docs.sparkSession.range(1).select(F.lit(None).cast(index.schema["_key"].dataType).alias("_key"), F.lit("").alias("_w"), F.lit(0).alias("_a"), F.array(F.lit("")).alias("_window"))
    # All of the test stands in the join itself, so that a row leaves it only for a window that occurs: the words array of
    # a long text is never copied for the words that don't.
    start, length = F.col("_p") - F.col("_a"), F.size("_window")
    occurs = (F.col("_v") == F.col("_w")) & (start >= 0) & (start + length <= F.size("_words")) & (F.slice("_words", start + 1, length) == F.col("_window"))
    is_end, found = F.col("_key").isNull(), None
    for part in range(parts):
        piece = index if parts == 1 else index.where(F.pmod(F.xxhash64("_key"), F.lit(parts)) == part)
        hit, n = F.when(~is_end, F.sequence(start, start + length - 1)), F.when(is_end, F.col("_p").cast("long"))
        met = spread.join(F.broadcast(piece if part else piece.unionByName(ends)), occurs).select("_id", "_h", "_key", hit.alias("_hit"), n.alias("_n"))
        found = met if found is None else found.union(met)
    by_doc = found.groupBy("_id", "_h").agg(
        F.max("_n").alias("n_words"),
        F.count("_n").cast("int").alias("_copies"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_hit")))).alias("_n_hit"),
        F.collect_set("_key").alias("_keys"),
    )
    # A repeated row is given as often as it was there.
    joined = by_doc.select(
        "_id", "_h", "n_words", "_n_hit", F.size("_keys").alias("_n_items"), F.array_sort(F.filter(F.col("_keys.id"), lambda x: x.isNotNull())).alias("_ids"), F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")
    )
    hits = F.coalesce(F.col("_n_hit"), F.lit(0)).cast("long")
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        hits.alias("n_hit"),
        F.coalesce(F.col("_n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_ids", F.array().cast("array<string>")).alias("items"),
        (hits > 0).alias("contaminated"),
        *([F.col("_h").alias("text_hash")] if with_hash else []),
    )
