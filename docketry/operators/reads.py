"""Repeated page reads, page overrides, incremental embedding, and slots filled from documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import normal_program, numbers
from docketry.functions.wording import period

PAGE = ("doc_id", "page")


def majority(reads: DataFrame) -> DataFrame:
    """Of each page the first read of the first group of two or more that agree on all numbers; else its first read.

    reads: doc_id, page, read_no, md. n_agreeing is the size of the group that was taken.
    """
    signed = reads.withColumn("_s", F.array_join(numbers(F.col("md")), " "))
    groups = signed.groupBy(*PAGE, "_s").agg(F.count("*").alias("n"), F.min("read_no").alias("first"), F.min_by("md", "read_no").alias("md"))
    order = F.struct((F.col("n") >= 2).cast("int"), -F.col("first"))
    return groups.groupBy(*PAGE).agg(F.max_by(F.struct("md", "n", F.col("first").alias("read_no")), order).alias("b")).select(*PAGE, "b.md", "b.read_no", F.when(F.col("b.n") >= 2, F.col("b.n")).otherwise(1).alias("n_agreeing"))


def self_consistency(reads: DataFrame, dense: Column) -> DataFrame:
    """identical: the first two reads agree on the numbers; not_checked: they don't, on a page that isn't dense;
    resolved_hi_res: two of the later, larger reads agree; no_majority otherwise. reads: doc_id, page, read_no, pass (1 or 2), md."""
    signed = reads.withColumn("_s", F.array_join(numbers(F.col("md")), " "))
    first = signed.where("pass = 1").groupBy(*PAGE).agg(F.countDistinct("_s").alias("kinds"), F.bool_or(dense).alias("dense"))
    again = signed.where("pass = 2").groupBy(*PAGE, "_s").agg(F.count("*").alias("n")).groupBy(*PAGE).agg(F.max("n").alias("most"))
    status = F.when(F.col("kinds") == 1, "identical").when(~F.col("dense"), "not_checked").when(F.coalesce("most", F.lit(0)) >= 2, "resolved_hi_res").otherwise("no_majority")
    return first.join(again, list(PAGE), "left").select(*PAGE, status.alias("self_consistency"))


def overridden(pages: DataFrame, overrides: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pages with what overrides say of them; of several overrides of a page the last that says something counts, column by column.

    overrides: doc_id, page, ord and the columns, null where they say nothing.
    """
    last = overrides.groupBy(*PAGE).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}") for c in columns))
    joined = pages.join(last, list(PAGE), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def embedded(chunks: DataFrame, done: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str = "chunk_id", text: str = "content", batch: int = 50) -> DataFrame:
    """Vectors of the chunks that have none yet, asked for in batches: key, embedding."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "embedding": embed(part[text].tolist())})

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.join(done.select(key), key, "left_anti").select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def document_slots(documents: DataFrame, slot_map: DataFrame, key: str = "session_id") -> DataFrame:
    """Slots that documents fill: key, slot, value. The most recent row of a repeated group counts, ties to the later row.

    documents: key, template, row_no, values (map of strings); slot_map: slot, template, field, fallback_field, recency_key; a
    small dimension. Null values fill nothing.
    """
    wanted = documents.join(F.broadcast(slot_map), "template")
    value = F.coalesce(F.col("values")[F.col("field")], F.col("values")[F.col("fallback_field")])
    recent = F.struct(period(F.col("values")[F.col("recency_key")]).alias("p"), "row_no")
    picked = wanted.groupBy(key, "slot").agg(F.max_by(value, F.when(value.isNotNull(), recent)).alias("value"))
    return picked.where(F.col("value").isNotNull())


def merged_slots(old: Column, new: Column) -> Column:
    """Maps merged, the new value where it isn't null."""
    fresh = F.map_filter(new, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)


def mentions(turns: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """Programs that a turn names as whole words, the longest name first: key, code, place. names: code, name; a small dimension.

    A name may carry what names drift by: an i or a number behind it, with or without a space or dash.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    own = names.select("code", F.trim(bare(F.col("name"))).alias("_n")).where("_n <> ''")
    hits = turns.select(key, F.concat(F.lit(" "), bare(F.col(text)), F.lit(" ")).alias("_t")).join(F.broadcast(own), F.regexp_like(F.col("_t"), F.concat(F.lit(" "), F.col("_n"), F.lit("(?: ?i| ?[0-9]+)? "))))
    best = hits.groupBy(key, "code").agg(F.max(F.length("_n")).alias("_l"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_l").desc(), "code"))).drop("_l")


def program_names(catalogue: DataFrame) -> DataFrame:
    """code and name: every program by its code and by what its full name shows in brackets. catalogue: program, full_name."""
    shown = F.regexp_extract_all("full_name", F.lit(r"\(([^)]+)\)"), 1)
    named = catalogue.where(F.trim("program") != "").select(F.trim("program").alias("code"), F.explode(F.concat(F.array(F.trim("program")), F.coalesce(shown, F.array().cast("array<string>")))).alias("name"))
    return named.select("code", F.trim("name").alias("name")).where("name <> ''").distinct()


def catalogue_sides(catalogue: DataFrame, indexed: DataFrame) -> DataFrame:
    """The catalogue's programs with `indexed_code`: the code under which the index has them, null where it hasn't; codes meet without their drift.

    catalogue: program, full_name; indexed: code. An empty index has no sides: no rows.
    """
    there = indexed.where(F.col("code").isNotNull()).groupBy(normal_program(F.col("code")).alias("_c")).agg(F.max("code").alias("indexed_code"))
    some = indexed.agg((F.count("code") > 0).alias("_some")).where("_some")
    own = catalogue.where(F.trim("program") != "").withColumn("_c", normal_program(F.col("program")))
    # One row, or none.
    return own.join(there, "_c", "left").join(F.broadcast(some), F.lit(True), "left_semi").drop("_c")


def rescued(scored: DataFrame, named: DataFrame, key: str, program_intent: str, specific: Column) -> DataFrame:
    """Off-topic turns that name a program become about programs, confidence 0.9 at least, unless their topic is specific."""
    there = named.select(key, F.lit(True).alias("_named")).distinct()
    take = F.coalesce("_named", F.lit(False)) & ~F.coalesce(specific, F.lit(False)) & ~F.col("primary").eqNullSafe(F.lit(program_intent))
    joined = scored.join(there, key, "left").withColumn("_take", take)
    return joined.withColumns({"primary": F.when(F.col("_take"), program_intent).otherwise(F.col("primary")), "confidence": F.when(F.col("_take"), F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence"))}).drop("_named", "_take")


def page_order(pages: DataFrame, hints: DataFrame) -> DataFrame:
    """Pages of each document in the order to look at them: hinted ones first, then the rest; hints beyond the pages are dropped."""
    hinted = hints.select(*PAGE).distinct().withColumn("_h", F.lit(0))
    by = Window.partitionBy("doc_id").orderBy(F.coalesce("_h", F.lit(1)), "page")
    return pages.select(*PAGE).distinct().join(hinted, list(PAGE), "left").withColumn("place", F.row_number().over(by)).drop("_h")
