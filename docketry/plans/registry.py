"""All queries of the library by name, and the SQL that states what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.plans import bundles, ledger, search, texts, turns, understanding

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (ledger, texts, turns, understanding, search, bundles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.account_years(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
