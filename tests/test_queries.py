import pytest
from oracle import assert_same

import __spark_entry__
from tessera import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert_same(df, registry.ORACLE_SQL[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry_lists_every_query(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(registry.QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["query_id", "id", "score", "rank"]
