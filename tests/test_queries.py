"""Every driver query that has SQL gives the SQL's rows; the others give rows of a steady schema."""

import pytest
from compare import rows_of, sql_rows
from gleanery.plans import more as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name not in plans.SQL:
        assert df.columns and df.count() > 0
        return
    cols, got = rows_of(df)
    want_cols, want = sql_rows(plans.SQL[name], sf_dir)
    assert cols == want_cols
    assert got == want
