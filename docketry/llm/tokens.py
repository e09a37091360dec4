"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import map_arrow, written


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder of a ranks file; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("docketry", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys` and n_tokens of every row; null and empty texts have 0 tokens, special tokens are ordinary text."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        encode = encoding(path, pattern).encode_ordinary
        lengths = [len(encode(t)) if t else 0 for t in batch.column(text_col).to_pylist()]
        return pa.table({**{k: batch.column(k) for k in keys}, "n_tokens": pa.array(lengths, pa.int64())})

    own = docs.select(*dict.fromkeys((*keys, text_col)))
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return map_arrow(own, run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n_tokens long"]))


def length_histogram(
    docs: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    text_col: str = "text",
    keys: tuple[str, ...] = (),
    block: int = 1024,
) -> DataFrame:
    """One row for each `keys` and encoded length, with the sums that answer questions about any context limit.

    n_docs: documents of this length; docs_from, tokens_from: documents and tokens of this length or more;
    docs_below, tokens_below: of a smaller length; truncated_total: tokens left when every document is cut at this
    length. Between two rows a limit L leaves tokens_below + L * docs_from of the next longer row (`truncated_at`).

    Texts are encoded where they are read; only (keys, length, count) rows are shuffled, combined before the shuffle, so a
    hot key is no hot task. The sums run in two levels, over blocks of lengths and inside each block: no window ever
    holds more than `block` lengths or the number of blocks of one key. Null keys form a group of their own; an empty table
    gives no rows; other columns are ignored.
    """
    if path is None or pattern is None:
        path, pattern = public_vocabulary()
    # Read twice below; the texts are encoded once.
    counted = written(encoded_lengths(docs, path, pattern, text_col, keys).groupBy(*keys, "n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counted = counted.withColumn("_block", F.expr(f"n_tokens div {block}")).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    by_block = counted.groupBy(*keys, "_block").agg(F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    offsets = by_block.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_block").alias("_b"),
        *(F.coalesce(F.sum(c).over(w), zero).alias(n) for c, w, n in (("_docs", before, "_d0"), ("_sum", before, "_t0"), ("_docs", after, "_d1"), ("_sum", after, "_t1"))),
    )
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_block").orderBy("n_tokens")
    below, on = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = counted.join(offsets, same).select(
        *keys,
        "n_tokens",
        "n_docs",
        (F.col("_d1") + F.sum("n_docs").over(on)).alias("docs_from"),
        (F.col("_t1") + F.sum("_tokens").over(on)).alias("tokens_from"),
        (F.col("_d0") + F.coalesce(F.sum("n_docs").over(below), zero)).alias("docs_below"),
        (F.col("_t0") + F.coalesce(F.sum("_tokens").over(below), zero)).alias("tokens_below"),
    )
    return out.withColumn("truncated_total", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_from"))


def truncated_at(histogram: DataFrame, limits: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """For each `keys` and limit: documents cut, whole documents, tokens in all and tokens left when cut at the limit.

    Read off the suffix sums: the shortest length above a limit tells what is cut, and a limit that no document exceeds is
    answered by the longest length. limits is a short list; repeated limits count once; an empty histogram gives no rows.
    """
    limit = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in sorted(set(limits)))))
    sums = F.struct("n_tokens", "docs_from", "tokens_from", "docs_below", "tokens_below")
    asked = histogram.select(*keys, "n_docs", sums.alias("_s"), limit.alias("context_limit"))
    found = asked.groupBy(*keys, "context_limit").agg(F.min(F.when(F.col("_s.n_tokens") > F.col("context_limit"), F.col("_s"))).alias("_above"), F.max("_s").alias("_last"))
    docs, total = F.col("_last.docs_below") + F.col("_last.docs_from"), F.col("_last.tokens_below") + F.col("_last.tokens_from")
    cut = F.coalesce("_above.docs_from", F.lit(0).cast("long"))
    return found.select(
        *keys,
        "context_limit",
        cut.alias("docs_cut"),
        (docs - cut).alias("docs_whole"),
        total.alias("tokens_total"),
        F.coalesce(F.col("_above.tokens_below") + F.col("context_limit") * F.col("_above.docs_from"), total).alias("tokens_left"),
    )


def quantile_lengths(histogram: DataFrame, quantiles: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles: the smallest length with at least that share of the documents at or below it; no rows for an empty histogram."""
    wanted = F.explode(F.array(*map(F.lit, quantiles))).alias("quantile")
    total, upto = F.col("docs_below") + F.col("docs_from"), F.col("docs_below") + F.col("n_docs")
    return (
        histogram.select("*", wanted).where(upto >= F.col("quantile") * total).groupBy(*keys, "quantile").agg(F.min("n_tokens").alias("n_tokens"))
    )
