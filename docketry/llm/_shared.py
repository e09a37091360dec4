"""Helpers that the training-data operators share: table paths, the shared folder, size estimates and Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space characters of the contracts, `[\x20\x09-\x0D]`; exactly the bytes that `bytes.split()` splits on.
SPACE = " \t\n\x0b\x0c\r"
#: Bits of one bitmap, as Spark's bitmap functions make them.
PIECE = 32_768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset in local mode.

    On a cluster there is no folder to fall back on: executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-docketry-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows once as a table in the shared folder and read them back.

    The table survives lost executors; it is removed when the application's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, from one pass over one column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()["b"]


def parts_for(n: int, each: int) -> int:
    """How many blocks of about `each` units hold n of them; at least 1."""
    return max(1, -(-int(n) // each))


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast df only when its counted rows stay within the bound; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= most else df


def perhaps_among(rows: DataFrame, key: str, wanted: DataFrame, n_wanted: int, most: int = 4_096) -> DataFrame:
    """rows without most of those whose key no row of `wanted` (one column, n_wanted rows) has; a row whose key is there always stays.

    So a join with few of many rows needn't shuffle them all. Of sixteen bits a wanted key one is set, in bitmaps of 32,768 bits that are
    sent to every executor; a key that isn't there stays with a chance of one in sixteen. Above `most` bitmaps (4 KB each) all rows stay. Null keys go.
    """
    pieces = parts_for(n_wanted * 16, PIECE)
    if pieces > most:
        return rows
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces * PIECE))
    set_ = wanted.toDF("_w").where("_w IS NOT NULL").select(place("_w").alias("_at"))
    bitmaps = set_.groupBy(F.expr(f"_at div {PIECE}").alias("_piece")).agg(F.bitmap_construct_agg(F.col("_at") % PIECE).alias("_bits"))
    placed = rows.where(F.col(key).isNotNull()).withColumn("_at", place(key)).withColumn("_piece", F.expr(f"_at div {PIECE}"))
    bit = F.expr(f"getbit(CAST(conv(hex(substring(_bits, CAST((_at % {PIECE}) div 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(_at % 8 AS INT))")
    return placed.join(F.broadcast(bitmaps), "_piece").where(bit == 1).select(*rows.columns)


def spread_join(rows: DataFrame, small: DataFrame, on: Column, row: Column, salts: int = 16) -> DataFrame:
    """Left join of rows with the smaller table, each of whose rows stands once for every salt; `row` tells the rows apart.

    Rows without a partner, nulls included, and rows of one very frequent key go to as many tasks as there are salts.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    copied = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, on & (F.col("_salt") == F.col("_copy")), "left").drop("_salt", "_copy")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that only so many texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow, one output table for an input batch; batches of all-empty input give nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            if out is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def ascii_lower(col):
    """Lower-case A-Z only. Texts that are ASCII throughout take the fast built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))
