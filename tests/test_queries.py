"""Every registered query outside the subpackage against its SQL; those without SQL run and give rows of a stable schema."""

from __future__ import annotations

import pytest

import __spark_entry__
from docketry.plans import registry
from tests.compare import SF_DIR, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    df = registry.queries()[name](spark, SF_DIR)
    assert df.schema == registry.queries()[name](spark, SF_DIR).schema and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
