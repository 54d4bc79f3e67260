import pytest

from fieldglass.plans import catalogue
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_equal_the_sql(spark, sf_dir, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf_dir)) == duck_rows(catalogue.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
