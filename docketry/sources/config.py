"""Readers of the files that describe a corpus: the document manifest, bounds of facts, products' limits. JSON, or YAML where it can be parsed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OVERRIDE = "struct<pages:array<int>,corpus:string,content_type:string,access_tier:string,skip:boolean>"
MANIFEST = (
    "doc_id string, program_code string, title string, source_pdf string, source_uri string, default_corpus string, default_access_tier string, version string, effective_date string, expiry_date string, "
    f"lang string, disambiguate_from array<string>, include_pages array<int>, page_ranges array<array<int>>, page_overrides array<{OVERRIDE}>"
)
BOUNDS = "array<struct<kind:string,unit:string,min:double,max:double,fields:array<string>>>"
PRODUCTS = "array<struct<program:string,full_name:string,min:double,max:double>>"


@F.pandas_udf(StringType())
def yaml_as_json(texts: pd.Series) -> pd.Series:
    import yaml

    return pd.Series([None if t is None else json.dumps(yaml.safe_load(t), default=str) for t in texts], dtype=object)


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    """The JSON text of each file under the path; a description is one small file, read by one task."""
    text = spark.read.text(path, wholetext=True)
    return text.select((yaml_as_json("value") if path.endswith((".yaml", ".yml")) else F.col("value")).alias("json"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of a manifest, a list of objects: see MANIFEST; a missing version reads as 1, a missing language as en.

    include_pages takes single pages, page_ranges pairs of a first and a last page; neither means all pages.
    """
    rows = whole_file(spark, path).select(F.explode(F.from_json("json", f"array<struct<{MANIFEST.replace(' string', ':string').replace(' array', ':array')}>>")).alias("m")).select("m.*")
    ranges = F.flatten(F.transform("page_ranges", lambda r: F.sequence(r[0], r[1])))
    pages = F.array_sort(F.array_union(F.coalesce("include_pages", F.array().cast("array<int>")), F.coalesce(ranges, F.array().cast("array<int>"))))
    day = lambda c: F.col(c).try_cast("date")
    return rows.withColumns({"include_pages": pages, "version": F.coalesce("version", F.lit("1")), "lang": F.coalesce("lang", F.lit("en")), "effective_date": day("effective_date"), "expiry_date": day("expiry_date")}).drop("page_ranges")


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """rule_ord, kind, unit, low, high, fields of the key `bounds`, in the file's order; a null bound is open."""
    rows = whole_file(spark, path).select(F.posexplode(F.from_json(F.get_json_object("json", "$.bounds"), BOUNDS)).alias("rule_ord", "b"))
    return rows.select("rule_ord", "b.kind", "b.unit", F.col("b.min").alias("low"), F.col("b.max").alias("high"), F.coalesce("b.fields", F.array().cast("array<string>")).alias("fields"))


def read_products(spark: SparkSession, path: str, key: str = "quantum") -> DataFrame:
    """program, full_name, min, max of the products under `key`; rows without a program are dropped, of repeated ones the last counts."""
    rows = whole_file(spark, path).select(F.posexplode(F.from_json(F.get_json_object("json", f"$.{key}"), PRODUCTS)).alias("ord", "p"))
    last = rows.where(F.coalesce("p.program", F.lit("")) != "").groupBy(F.col("p.program").alias("program")).agg(F.max_by("p", "ord").alias("p"))
    return last.select("program", "p.full_name", "p.min", "p.max")
