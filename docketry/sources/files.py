"""Readers and writers beside tables: bundles, pages, facts, files by their bytes, partitioned output, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.shaping import DATA_TYPES, FREQUENCIES, shown_as, templates

# Uploads that are admitted.
MIME_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/webp", "image/tiff")
EXTENSIONS = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff"}
MOST_BYTES = 20 * 1024 * 1024


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Extraction bundles, a JSON object by file keyed by template: bundle_id (the file's name), template, payload as JSON text."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("bundle_id"), F.from_json("value", "map<string,string>").alias("m"))
    return whole.select("bundle_id", F.explode("m").alias("template", "payload"))


def read_corpora(spark: SparkSession, root: str, schema: str, corpora: list[str] | None = None, docs: list[str] | None = None) -> DataFrame:
    """JSON lines in corpus= directories; corpora prune directories, docs filter rows."""
    rows = spark.read.schema(schema).json(root)
    rows = rows.where(F.col("corpus").isin(*corpora)) if corpora else rows
    return rows.where(F.col("doc_id").isin(*docs)) if docs else rows


def read_templates(spark: SparkSession, root: str) -> DataFrame:
    """The template catalogue out of its three tables under the root (templates, template_attributes, attributes), as `shaping.templates` gives it, types and frequencies as they are displayed."""
    t, links, a = (spark.read.parquet(f"{root}/{name}") for name in ("templates", "template_attributes", "attributes"))
    text = lambda df, c, name: df[c].cast("string").alias(name)
    links = links.select(text(links, "template_id", "template_id"), text(links, "attribute_id", "attribute_id"), text(links, "id", "link_ord"), shown_as(F.col("frequency"), FREQUENCIES).alias("frequency"), "row_group")
    attributes = a.select(text(a, "id", "attribute_id"), F.col("name").alias("attribute_name"), shown_as(F.col("data_type"), DATA_TYPES).alias("data_type"))
    return templates(t.select(text(t, "id", "template_id"), F.col("name").alias("template_name")), links, attributes)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One text file a page, named page_<number>: doc_id is the directory's name."""
    where = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract(where, r"page_(\d+)\.", 1).try_cast("int").alias("page"), F.col("value").alias("md")
    )


def with_facts(pages: DataFrame, facts: DataFrame, schema: str = "array<struct<field:string,value:double,unit:string,verbatim:string>>") -> DataFrame:
    """Pages with their facts. facts: doc_id, page, json. Tells a file that is missing from one that doesn't parse."""
    bare = F.trim(F.regexp_replace("json", r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    joined = pages.join(facts.select("doc_id", "page", bare.alias("_json")), ["doc_id", "page"], "left")
    parsed = F.from_json("_json", schema)
    good = F.try_parse_json(F.col("_json")).isNotNull() & parsed.isNotNull()
    return joined.withColumns({"facts": F.when(good, parsed), "is_missing": F.col("_json").isNull(), "parse_error": F.col("_json").isNotNull() & ~good}).drop("_json")


def admit_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of the binaryFile source that are admitted, and those that aren't, with the reason."""
    kind = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]
    reason = F.when(kind.isNull(), "unsupported type").when(F.col("length") == 0, "empty file").when(F.col("length") > MOST_BYTES, "too large")
    judged = files.withColumns({"mime_type": kind, "reason": reason})
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("path", "length", "reason")


def pdf_markers(files: DataFrame) -> DataFrame:
    """Counts of structural marks in raw bytes; updates after the first version are the end marks less one."""
    text = F.decode("content", "ISO-8859-1")
    ends = F.regexp_count(text, F.lit("%%EOF"))
    return files.select("path", ends.alias("n_eof"), F.regexp_count(text, F.lit("startxref")).alias("n_startxref"), F.regexp_count(text, F.lit("/JavaScript|/JS")).alias("n_javascript"), F.greatest(ends - 1, F.lit(0)).alias("n_updates"))


def table_signature(tables: Column) -> Column:
    """Sixteen hex digits that name an encoder by its quantisation tables, in any order."""
    return F.substring(F.sha2(F.to_json(F.array_sort(tables)), 256), 1, 16)


def estimated_quality(table: Column, reference: Column) -> Column:
    """Quality of 1 to 100 from the mean scale of a 64-value table against the reference table at quality 50."""
    scale = F.aggregate(F.zip_with(table, reference, lambda a, b: a.cast("double") * 100 / b), F.lit(0.0), lambda s, x: s + x) / F.size(table)
    quality = F.when(scale <= 100, (200 - scale) / 2).otherwise(5000 / scale)
    return F.greatest(F.lit(1), F.least(F.lit(100), F.round(quality))).cast("int")


def first_seen(images: DataFrame, most: int = 25) -> DataFrame:
    """Images of a document once for each key, in the order first seen, with all their pages; the first `most` of a document."""
    from pyspark.sql import Window

    once = images.groupBy("doc_id", "key").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("page")).alias("pages"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("place") <= most)


def write_chunks(chunks: DataFrame, root: str, fmt: str = "json") -> None:
    """A directory for each corpus and document."""
    chunks.repartition("corpus", "doc_id").write.mode("overwrite").partitionBy("corpus", "doc_id").format(fmt).save(root)


def write_with_manifest(rows: DataFrame, path: str, manifest: str, stage: str, as_of: str) -> None:
    """Writes rows and appends what was written to the manifest: stage, count, as_of. Counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation("written")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    rows.sparkSession.createDataFrame([(stage, seen.get["n"], as_of)], "stage string, n_rows long, as_of string").write.mode("append").parquet(manifest)


def reset(spark: SparkSession, path: str, schema: str) -> None:
    """An empty store of the same schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def discard(rows: DataFrame) -> None:
    """Computes rows and keeps none."""
    rows.write.format("noop").mode("overwrite").save()
