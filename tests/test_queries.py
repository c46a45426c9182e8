import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    return sorted(tuple(sorted((k, f"{v:.9g}" if isinstance(v, float) else str(v)) for k, v in zip(columns, r, strict=True))) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["captions", "map_markers"])
def test_zeros_keep_their_sign(spark, tmp_path, name):
    """Orders 2252198 and 4074838 are drawn just west of longitude 0, which rounds to -0.0, and prints so."""
    keys = [(k, s) for k, s in enumerate(["1-URGENT", "4-NOT SPECIFIED"])] + [(2252198, "4-NOT SPECIFIED"), (4074838, "2-HIGH")]
    spark.createDataFrame(keys, "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    df = entry.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = c.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = plain(want.fetchall(), columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == rows
    assert sum("-0.000000" in str(r) for r in rows) == 2


def test_markers_of_nulls(spark, tmp_path):
    """A popup is null if the order has no priority or no key, as in the SQL; the rows stay."""
    keys = [(5, None), (None, "2-HIGH"), (None, None), (-7, "1-URGENT"), (8, "")]
    spark.createDataFrame(keys, "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    df = entry.queries()["map_markers"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = c.execute(entry.oracle_sql()["map_markers"])
    columns = [d[0] for d in want.description]
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert plain(rows, columns) == plain(want.fetchall(), columns)
    assert len(rows) == 5 and sum(r[columns.index("popup")] is None for r in rows) == 3
