"""Every registered query against the same result in SQL, or for rows alone where it has none."""

import pytest
from conftest import same_rows

from siftworks.plans import all_queries


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = all_queries.QUERIES[name](spark, sf_dir)
    if name in all_queries.SQL:
        same_rows(df, duck, all_queries.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(all_queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
