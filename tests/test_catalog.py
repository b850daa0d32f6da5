"""Every query with an oracle gives the oracle's rows."""

import math
import os

import duckdb
import pytest

from kinfold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    held = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in held.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: [str(x) for x in row]
    want = sorted(([tidy(v) for v in row] for row in held.fetchall()), key=key)
    got = sorted(([tidy(r[c]) for c in names] for r in df.collect()), key=key)
    assert got == want
