"""Some queries against their SQL over the smallest tables; the driver compares them all."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["q_classify_all", "q_matrix", "q_meta_per_gene", "q_meta_advanced", "q_validate_status", "q_fuzzy_match", "q_table_diff", "q_flatfile_roundtrip"])
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, str(DATA))
    got = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == Counter(got.fetchall())
