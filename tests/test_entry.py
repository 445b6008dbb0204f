from __future__ import annotations

import os

import __spark_entry__ as entry
import duckdb
import pytest
from faultline.plans.artifact_queries import ORACLES
from faultline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    return None if value is None else f"{value:.5f}" if isinstance(value, float) else str(value)


QUICK = [q for q in ORACLES if q not in ("findings", "contributions", "gate", "risk_classification", "blast_radius")]


@pytest.mark.parametrize("name", QUICK)
def test_matches_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([[plain(r[c]) for c in columns] for r in df.collect()], key=str)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted([[plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()], key=str)


def test_entry(spark):
    assert entry.entry(spark).columns == ["change_id", "score", "classification"]
