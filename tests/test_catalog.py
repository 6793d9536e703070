import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, expected = catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows_of(got, columns) == rows_of(expected, columns)


def test_entry_and_registry(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.HAS_LLM == (importlib.util.find_spec("tidemark.llm") is not None)
