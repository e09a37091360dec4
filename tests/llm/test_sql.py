"""The subpackage's queries against their SQL."""

from __future__ import annotations

import pytest

from docketry.llm import queries, sql
from tests.compare import same


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, queries.queries()[name], sql.oracle_sql()[name])
