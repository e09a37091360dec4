"""Tri-state rules over bundles: statuses, folds, grouping, and the rules that documents' tables decide."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = ("bundle_id", "rule_id", "check", "passed", "status", "message")


def status_of(passed: Column, skipped: Column) -> Column:
    """A null outcome is either not applicable or in need of review; only `skipped` tells."""
    return F.when(skipped, "not_applicable").when(passed.isNull(), "needs_review").when(passed, "passed").otherwise("failed")


def with_status(checks: DataFrame) -> DataFrame:
    return checks.withColumn("status", status_of(F.col("passed"), F.col("skipped")))


def fold(results: DataFrame, key: str) -> DataFrame:
    """A report for each key: counts by status; failed outranks needs_review outranks passed; not applicable doesn't count."""
    of = lambda s: F.count_if(F.col("status") == s)
    out = results.groupBy(key).agg(
        of("passed").alias("n_passed"),
        of("failed").alias("n_failed"),
        of("needs_review").alias("n_review"),
        of("not_applicable").alias("n_skipped"),
        F.every(F.coalesce("passed", F.lit(True))).alias("overall_passed"),
    )
    return out.withColumn("overall_status", F.when(F.col("n_failed") > 0, "failed").when(F.col("n_review") > 0, "needs_review").otherwise("passed"))


def checked(results: DataFrame) -> DataFrame:
    """The result contract: these columns of these types, or an error before anything runs."""
    types = {f.name: f.dataType.simpleString() for f in results.schema.fields}
    wanted = {"bundle_id": None, "rule_id": "string", "check": "string", "passed": "boolean", "status": "string", "message": "string"}
    for name, kind in wanted.items():
        if name not in types or kind and types[name] != kind:
            raise TypeError(f"rule result column {name}: expected {kind or 'any type'}, got {types.get(name)}")
    return results.select(*RESULT)


def grouped(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Results by document group; rules the catalogue doesn't know go to OTHER. The base check name is the text before [."""
    known = results.withColumn("rule_id", F.coalesce("rule_id", F.split_part("check", F.lit("["), F.lit(1))))
    joined = known.join(F.broadcast(catalogue.select("rule_id", "group_name")), "rule_id", "left")
    return joined.groupBy("bundle_id", F.coalesce("group_name", F.lit("OTHER")).alias("group_name")).agg(
        F.array_sort(F.collect_list(F.struct("rule_id", "check", "status"))).alias("results"), F.count("*").alias("n_results")
    )


def run_all(rules: Sequence[tuple[str, Callable[..., DataFrame]]], tables: dict[str, DataFrame], policy: dict) -> DataFrame:
    """All rules of a registry, in its order, over all bundles at once. Dates are judged as of each bundle's system_date."""
    out: DataFrame | None = None
    for i, (rule_id, rule) in enumerate(rules):
        rows = checked(rule(tables, policy).withColumn("rule_id", F.lit(rule_id))).withColumn("rule_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no rules")
    return out


def per_bundle(bundles: DataFrame, outcomes: DataFrame, check: str, message: Column) -> DataFrame:
    """One row for each bundle: its outcome, or not applicable where `outcomes` has none. outcomes: bundle_id, passed, and what the message names."""
    joined = bundles.select("bundle_id").join(outcomes.withColumn("_there", F.lit(True)), "bundle_id", "left")
    skipped = F.col("_there").isNull()
    return joined.select("bundle_id", F.lit(check).alias("check"), "passed", status_of(F.col("passed"), skipped).alias("status"), F.when(skipped, "no such documents").otherwise(message).alias("message"))


def tri_state_and(flags: Sequence[Column]) -> Column:
    """False if any is false, else null if any is null, else true: a missing answer never outranks a no."""
    no = F.lit(False)
    unknown = F.lit(False)
    for f in flags:
        no |= F.coalesce(~f, F.lit(False))
        unknown |= f.isNull()
    return F.when(no, F.lit(False)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(True))
