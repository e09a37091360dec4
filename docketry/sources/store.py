"""A store of rows by key, hashed into buckets: a batch rewrites the buckets that it touches and leaves the others' files alone.

Layout under `root`: `data/batch=<n>/bucket=<b>` holds a bucket as batch n left it; `commits/commit=<n>` tells which batch's
files each bucket has after batch n. A batch counts once its commit is there; one that failed before that leaves files that no
commit names, and writes the same ones again when it is run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketry.operators.corpus import latest, upserted

PLACES = "bucket int, batch long"


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def committed(spark: SparkSession, root: str, upto: int | None = None) -> tuple[int, dict[int, int]]:
    """The last commit (before `upto`) and the batch of each bucket's files; -1 and nothing for a new store. As many rows as buckets."""
    try:
        commits = spark.read.schema(f"{PLACES}, commit long").parquet(f"{root}/commits")
        commits = commits.where(F.col("commit") < upto) if upto is not None else commits
        last = commits.agg(F.max("commit")).first()[0]
    except AnalysisException:  # nothing was committed yet
        return -1, {}
    if last is None:
        return -1, {}
    return last, {r["bucket"]: r["batch"] for r in commits.where(F.col("commit") == last).collect() if r["bucket"] is not None}


def read_store(spark: SparkSession, root: str, schema: StructType, commit: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The rows as of the last commit, or of an earlier one; of the buckets in `only`, if given."""
    _, places = committed(spark, root, None if commit is None else commit + 1)
    paths = [f"{root}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(places.items()) if only is None or bucket in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batch(incoming: DataFrame, number: int, root: str, key: str, order: tuple[str, ...] = (), buckets: int = 64) -> None:
    """Merge a batch: of repeated keys the row that is last by `order`, over what the store had before this batch.

    A number that was committed changes nothing. Only the buckets that the batch has keys of are read and written; a join meets a
    bucket's rows with the batch's by key, and each bucket is one directory of its own.
    """
    spark = incoming.sparkSession
    before, places = committed(spark, root)
    if before >= number:
        return
    new = latest(incoming, key, order).withColumn("bucket", bucket_of(key, buckets))
    touched = {r[0] for r in new.select("bucket").distinct().collect()}  # at most as many as there are buckets
    if touched:
        old = read_store(spark, root, incoming.schema, only=touched)
        merged = upserted(old, new.drop("bucket"), key, order).withColumn("bucket", bucket_of(key, buckets))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/batch={number}")
    after = places | dict.fromkeys(touched, number)
    rows = spark.createDataFrame(sorted(after.items()) or [(None, None)], PLACES)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/commit={number}")
