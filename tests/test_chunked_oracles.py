"""Registered queries beside their SQL while every series is cut into many chunks, so that carries and repairs are what is tested."""

from __future__ import annotations

import math

import duckdb
import pytest

from tapeline.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
PARTS = (
    "structure_", "trades_", "metrics_max", "ma_mcginley", "ma_vidya", "ma_kalman", "trend_supertrend", "trend_sar", "trend_half_trend", "trend_ut",
    "trend_volumatic", "trend_magic", "trend_kalman",
)
NAMES = sorted(n for n in ORACLES if n.startswith(PARTS))


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for t in ("orders", "events", "lineitem", "customer", "supplier", "nation", "part", "region"):
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return out


@pytest.fixture
def many_chunks(spark):
    spark.conf.set("spark.tapeline.chunkRows", "64")
    yield
    spark.conf.unset("spark.tapeline.chunkRows")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return round(v + 0.0, 2) if isinstance(v, float) else v


def near(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=0.02)) for x, y in zip(a, b))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, many_chunks, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(cell(v) for v in r) for r in df.select(*names).collect()), key=str)
    cur = con.execute(ORACLES[name])
    head = [c[0] for c in cur.description]
    want = sorted((tuple(cell(r[head.index(n)]) for n in names) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    assert all(near(a, b) for a, b in zip(got, want)), [(a, b) for a, b in zip(got, want) if not near(a, b)][:3]
