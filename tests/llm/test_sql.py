"""Queries of the training-data operators against their SQL equivalents, and the hash that two of them share."""

import os
import random

import duckdb
import pytest
import xxhash

from etlscope.llm import queries, sqlhash

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(SQL[name])
    order = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in order]
    want = sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
    assert sorted(df.columns) == order
    assert sorted(tuple(str(x) for x in r) for r in df.select(*order).collect()) == want


def test_hash_in_sql(duck):
    random.seed(1)
    texts = ["".join(random.choices("abé中 x9\x00", k=n)) for n in [*range(90), 200, 1000]]
    duck.execute("CREATE OR REPLACE TABLE texts (s VARCHAR, k UBIGINT)")
    duck.executemany("INSERT INTO texts VALUES (?, ?)", [(t, random.getrandbits(64)) for t in texts])
    for seed in ("42", "k"):
        rows = duck.execute(f"WITH {sqlhash.xxh64('q', 'texts', 's', seed, 's, k')} SELECT s, k, h FROM q").fetchall()
        assert len(rows) == len(texts) and all(xxhash.xxh64(s.encode(), seed=42 if seed == "42" else k).intdigest() == h for s, k, h in rows)
