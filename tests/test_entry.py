"""The driver's contract."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p2_found", "p5_found", "q_matrix"} <= set(queries)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_flagship_and_general_queries(spark):
    assert entry.entry(spark).count() > 0
    for name, columns in (("p2_found", ["row_id", "field_name", "pos", "item"]), ("p5_found", ["row_id", "moment"])):
        df = entry.queries()[name](spark, str(DATA))
        assert df.columns == columns and df.count() > 0 and df.count() == df.distinct().count()
