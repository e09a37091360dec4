"""Calendar checks over sets of months and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.dates import leftover_days, months_in_range, whole_months


def month_counts(statements: DataFrame, key: str, statement: str, month: str = "month") -> DataFrame:
    """Statements of each month, each counted once."""
    return statements.select(key, statement, month).distinct().groupBy(key, month).agg(F.count("*").alias("n_statements"))


def month_gaps(counts: DataFrame, key: str, month: str = "month") -> DataFrame:
    """Months between a key's first and last that none covers."""
    span = counts.groupBy(key).agg(F.min(month).alias("a"), F.max(month).alias("b"))
    expected = span.select(key, F.explode(months_in_range(F.col("a"), F.col("b"))).alias(month))
    return expected.join(counts.select(key, month), [key, month], "left_anti")


def month_overlaps(counts: DataFrame) -> DataFrame:
    return counts.where("n_statements > 1")


def continuity(statements: DataFrame, key: str, statement: str, month: str = "month") -> DataFrame:
    """Per key: first and last month, missing and repeated months, and whether there are neither."""
    counts = month_counts(statements, key, statement, month)
    span = counts.groupBy(key).agg(
        F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count("*").alias("n_months"), F.count_if(F.col("n_statements") > 1).alias("n_overlaps")
    )
    months = F.months_between("last_month", "first_month").cast("long") + 1
    return span.withColumn("n_missing", months - F.col("n_months")).withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_overlaps") == 0))


def year_series(dates: DataFrame, key: str, date: str) -> DataFrame:
    """Per key: years in order, repeated years, missing years between first and last."""
    years = dates.select(key, F.year(date).alias("y")).groupBy(key, "y").agg(F.count("*").alias("n"))
    out = years.groupBy(key).agg(
        F.array_sort(F.collect_list("y")).alias("years"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("y")))).alias("repeated"),
        F.min("y").alias("a"),
        F.max("y").alias("b"),
    )
    return out.select(key, "years", "repeated", F.array_except(F.sequence("a", "b"), "years").alias("missing"))


def spacing_drift(dates: DataFrame, key: str, date: str, tolerance_days: int = 45) -> DataFrame:
    """Dates that are further than the tolerance from one year after the date before."""
    by = Window.partitionBy(key).orderBy(date)
    drift = F.datediff(F.col(date), F.add_months(F.lag(date).over(by), 12))
    return dates.select(key, date, drift.alias("drift_days")).where(F.abs("drift_days") > tolerance_days)


def part_months(start, end):
    """Whole months from start to end, a started one counted in full."""
    return whole_months(start, end) + (leftover_days(start, end) > 0).cast("int")


def freshness(latest: DataFrame, date: str, as_of, max_months: int = 18) -> DataFrame:
    """Age in months (started ones count), and whether it is within the limit; a date after as_of fails with no age."""
    ahead = F.col(date) > as_of
    age = F.when(~ahead, part_months(F.col(date), as_of))
    return latest.withColumn("age_months", age).withColumn("passed", F.coalesce(F.col("age_months") <= max_months, F.when(F.col(date).isNotNull(), F.lit(False))))
