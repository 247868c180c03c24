"""Every registered query against its SQL, or at least with rows where SQL can't express it."""

import pytest

from cubeloom import registry
from compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE:
        assert_same(df, duck, registry.ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
