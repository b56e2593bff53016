"""Every registered query against its DuckDB oracle (row count, columns, value hash)."""

import pytest

from repolens.plans.registry import REGISTRY
from repolens.plans.verify import compare

from .conftest import SF001


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF001, [name], verbose=False)[name]
    assert res.get("error") is None, res
    if REGISTRY[name].oracle is None:
        assert res["rows"] >= 0
    else:
        assert res["ok"], res


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["repo", "from_tag", "to_tag", "changelog"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
