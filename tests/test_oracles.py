"""Every query with SQL gives what DuckDB gives."""

import pytest
from conftest import duck_rows, spark_rows

from treeloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query(name, spark, sf_dir):
    assert spark_rows(catalogue.queries()[name](spark, sf_dir)) == duck_rows(catalogue.oracles()[name], sf_dir)


def test_every_oracle_has_a_query():
    assert set(catalogue.oracles()) <= set(catalogue.queries())
