import re

import pytest

import __spark_entry__ as entry
from tablewright.registry import load_all

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# A few queries of each part run here; check_queries.py runs all of them.
SAMPLE = ["profile_quantiles", "clean", "diff_rows_by_key", "insight_numeric", "version_apply", "catalog_warned",
          "trim_whitespace", "one_hot_encode", "row_index", "sql_self_join"]


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150
    # The corpus queries come and go together with their subpackage, and the table part has none of their names.
    corpus = [re.match(r"op(\d+)_|pipeline", n) for n in queries]
    numbers = sorted(int(m[1] or 0) for m in corpus if m)
    assert numbers in ([], list(range(14)))
    assert not [n for n in load_all()[0] if re.match(r"op\d|pipeline", n)]


def test_entry(spark):
    assert entry.entry(spark).count() == 11


@pytest.fixture(scope="module")
def db(sf):
    import duckdb
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, sf, db, name):
    from check_queries import canonical_rows
    df = entry.queries()[name](spark, sf)
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical_rows(df.columns, df.collect()) == canonical_rows(columns, result.fetchall())
