"""Each query against its SQL on a small table, as the driver does."""

import math
import os

import duckdb
import pytest

from gridloom.plans.oracle import SQL
from gridloom.plans.queries import QUERIES
from gridloom.sources import OutputFile

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.12g}") + 0.0 if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(x) for x in r) for r in df.select(columns).collect()), key=str)
    result = oracle.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[i]) for i in place) for r in result.fetchall()), key=str)
    assert found == wanted


def test_output_file(spark, tmp_path):
    out = OutputFile(spark, f"file://{tmp_path}", "run", dx=0.5)
    out.output("energy", t=0, rho=1.0)
    out.output("energy", t=1, rho=0.5)
    assert sorted(r.rho for r in out.read("energy").collect()) == [0.5, 1.0]
    with pytest.raises(ValueError):
        out.output("energy", t=2)
    again = OutputFile(spark, f"file://{tmp_path}", "run")
    assert again.path != out.path
    assert {r.name: r.value for r in out.read("attributes").collect()}["dx"] == "0.5"
