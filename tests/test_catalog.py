import pytest

import __spark_entry__ as entry
from impactrank import catalog
from oracle import oracle_rows, rows_of


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, name):
    assert rows_of(catalog.queries()[name](spark, sf_dir)) == oracle_rows(sf_dir, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
