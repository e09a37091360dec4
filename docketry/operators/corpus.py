"""The searchable corpus: chunk packing, versions, upserts, verification and index reports."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def packed(units: DataFrame, doc: str, max_tokens: int = 800, merge_tokens: int = 50, order: str = "ord") -> DataFrame:
    """Greedy packing of a document's units, in order, into chunks of at most max_tokens: doc, chunk_no, units, tokens.

    units: doc, order, unit, tokens, has_table. A unit with a table stands alone; a last chunk of under merge_tokens joins the
    one before unless either holds a table. Null tokens count as none, a null has_table as a table; units of one place go by their text.

    What a chunk holds depends on all before it, so a document's units pass one task in order; that task holds two chunks at a
    time, however long the document is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(_units(batches), max_tokens, merge_tokens)
        while some := list(islice(chunks, 1_000)):
            docs, places, texts, tokens = zip(*some, strict=True)
            yield pa.RecordBatch.from_pydict({doc: pa.array(docs, kind), "chunk_no": pa.array(places, pa.int32()), "units": pa.array(texts, pa.list_(pa.string())), "tokens": pa.array(tokens, pa.int64())})

    kind = to_arrow_type(units.schema[doc].dataType)
    own = units.repartition(F.col(doc)).sortWithinPartitions(doc, order, "unit")
    rows = own.select(F.col(doc).alias("d"), F.col("unit").cast("string").alias("u"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("t"), F.coalesce("has_table", F.lit(True)).alias("x"))
    return rows.mapInArrow(run, f"`{doc}` {units.schema[doc].dataType.simpleString()}, chunk_no int, units array<string>, tokens long")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("d", "u", "t", "x")), strict=True)


def _chunks(units: Iterator[tuple], max_tokens: int, merge_tokens: int) -> Iterator[tuple]:
    """(document, number, units, tokens) of each chunk; units are (document, unit, tokens, has_table), a document's next to each other."""
    for doc, rows in groupby(units, key=itemgetter(0)):
        number, held, last = 0, None, None  # chunks as [units, tokens, has_table]; `held` may still take the last one in
        for _, unit, tokens, table in rows:
            if last is not None and not table and not last[2] and (last[1] == 0 or last[1] + tokens <= max_tokens):
                last[0].append(unit)
                last[1] += tokens
                continue
            if held is not None:
                yield doc, number, held[0], held[1]
                number += 1
            held, last = last, [[unit], tokens, table]
        if held is not None and not held[2] and not last[2] and last[1] < merge_tokens:
            held, last = None, [held[0] + last[0], held[1] + last[1], False]
        for chunk in filter(None, (held, last)):
            yield doc, number, chunk[0], chunk[1]
            number += 1


def latest(rows: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Of the rows of each key the one that is last by `order`, ties by all columns; null is a key as well."""
    others = [c for c in rows.columns if c != key]
    by = F.struct(*order, *others) if others else F.lit(0)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), by).alias("_r"))
    return last.select("_r.*")


def upserted(existing: DataFrame, incoming: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows without an incoming one, and of each incoming key the row that is last by `order`."""
    new = latest(incoming, key, order)
    there = new.select(F.col(key).alias("_k"))
    return existing.join(there, F.col(key).eqNullSafe(F.col("_k")), "left_anti").unionByName(new)


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """A dry run: how many incoming rows would be inserted and updated."""
    known = incoming.join(existing.select(F.col(key), F.lit(True).alias("_there")).distinct(), key, "left")
    return known.agg(F.count_if(F.col("_there").isNull()).alias("inserts"), F.count_if(F.col("_there").isNotNull()).alias("updates"))


def superseded(existing: DataFrame, incoming: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Existing rows of other versions of an incoming document expire when the incoming one takes effect, unless they do before."""
    new = incoming.select(F.col(doc), F.col("version").alias("_v"), F.col("effective_date").alias("_e")).distinct()
    joined = existing.join(new, doc, "left")
    later = F.col("_v").isNotNull() & (F.col("version") != F.col("_v")) & (F.col("expiry_date").isNull() | (F.col("expiry_date") > F.col("_e")))
    return joined.withColumn("expiry_date", F.when(later, F.col("_e")).otherwise(F.col("expiry_date"))).drop("_v", "_e")


def verification(flags: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Per document: pages, passed and flagged pages, distinct reasons in order, flagged pages in order. flags: doc, page, reason."""
    by_page = flags.groupBy(doc, page).agg(F.collect_set("reason").alias("reasons"))
    joined = pages.select(doc, page).join(by_page, [doc, page], "left")
    return joined.groupBy(doc).agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("reasons").isNull()).alias("n_passed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
        F.array_sort(F.collect_list(F.when(F.col("reasons").isNotNull(), F.col(page)))).alias("flagged_pages"),
    )


def index_report(chunks: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Counts by corpus, by tier, by review state and in all, with expired chunks and those that expire within the days."""
    gone = F.col("expiry_date") <= as_of
    soon = (F.col("expiry_date") > as_of) & (F.col("expiry_date") <= F.date_add(as_of, days))
    return chunks.groupingSets(
        [[F.col("corpus")], [F.col("access_tier")], [F.col("needs_review")], []], F.col("corpus"), F.col("access_tier"), F.col("needs_review")
    ).agg(F.count("*").alias("n_chunks"), F.count_if(gone).alias("n_expired"), F.count_if(soon).alias("n_expiring"))


def windows(words: DataFrame, doc: str, order: str, word: str, size: int) -> DataFrame:
    """Every run of `size` words next to each other: doc, first place, words."""
    from pyspark.sql import Window

    ahead = Window.partitionBy(doc).orderBy(order).rowsBetween(0, size - 1)
    runs = words.select(doc, F.col(order).alias("first"), F.collect_list(word).over(ahead).alias("words"))
    return runs.where(F.size("words") == size)


def expired_versions(chunks: DataFrame, as_of: Column, doc: str = "doc_id", version: str = "version") -> DataFrame:
    """Distinct document versions that expired before the day: doc, version, expiry_date."""
    return chunks.where(F.col("expiry_date") < as_of).select(doc, version, "expiry_date").distinct()


def review_order(pages: DataFrame, doc: str = "doc_id", page: str = "page", flagged: str = "flagged") -> DataFrame:
    """Adds place, from 1: a document's flagged pages first, then by page; a null flag is none."""
    by = Window.partitionBy(doc).orderBy(F.coalesce(flagged, F.lit(False)).desc(), page)
    return pages.withColumn("place", F.row_number().over(by))
