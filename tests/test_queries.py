import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from weir import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf001):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf001, name):
    df = queries.QUERIES[name](spark, sf001)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("texts", [[], [None, ""], ["a b the", None]])
def test_file_passes_of_odd_texts_equals_sql(spark, tmp_path, texts):
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["pass"], r["word"], r["n"]) for r in queries.QUERIES["file_passes"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted((r[0], r[1], int(r[2])) for r in con.sql(f"SELECT pass, word, n FROM ({queries.ORACLE_SQL['file_passes']})").fetchall())


def test_dispersion_reads_its_key_alone(spark, sf001, capsys):
    """No other column is read or hashed to deal; equal keys give the same sums in any order."""
    queries.QUERIES["rr_dispersion"](spark, sf001).explain("formatted")
    assert set(re.findall(r"ReadSchema: (.*)", capsys.readouterr().out)) == {"struct<event_id:bigint>"}


@pytest.mark.parametrize("ids", [[], [None], [None, 5, 5, 5, 5, 5, None], [2**53 + 1, 2**53, -(2**62), 2**62, 7]])
def test_dispersion_of_odd_keys_equals_sql(spark, tmp_path, ids):
    """Null keys come first, as Spark orders them and DuckDB does if told so."""
    rows = [(i, f"payload {k}") for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.instance, r.n, r.ids) for r in queries.QUERIES["rr_dispersion"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute("SET default_null_order = 'nulls_first'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT instance, n, ids FROM ({queries.ORACLE_SQL['rr_dispersion']})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["word", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
