"""Every registered core query against its SQL equivalent in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from etlscope import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return f"{float(v):.6g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in want.description], want.fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


def test_revenue_that_ends_in_a_half_is_summed_exactly(spark, tmp_path):
    """Amounts whose floating sums fall just short of the half that their exact sums reach."""
    lines = {1: [(55211.28, 0.05), (12802.9, 0.04)], 2: [(38942.0, 0.09), (75662.4, 0.05)], 3: [(6846.8, 0.06), (34754.6, 0.02)]}
    for name in os.listdir(SF):
        if name not in ("lineitem.parquet", "orders.parquet"):
            (tmp_path / name).symlink_to(f"{SF}/{name}")
    items = spark.createDataFrame([(o, p, d) for o, rows in lines.items() for p, d in rows], "l_orderkey long, l_extendedprice double, l_discount double")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    customers = sorted(r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").limit(3).collect())
    spark.createDataFrame([(o, c) for o, c in zip(lines, customers, strict=True)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["cust_id"]: (r["total_rev"], r["big_rev"]) for r in queries.a_pipeline(spark, str(tmp_path)).collect()}
    assert got == dict(zip(customers, [(64742, 0), (107317, 0), (40496, 0)], strict=True))
