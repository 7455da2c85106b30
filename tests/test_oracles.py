"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    line = compare(spark, con, name, sf_dir)
    assert line.startswith("ok"), line


def test_entry_has_a_row_per_label(spark):
    result = entry.entry(spark)
    assert result.columns == ["label", "n_real", "n_generated", "frechet_distance", "n", "classifier_score"]
    assert result.count() == 10


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
