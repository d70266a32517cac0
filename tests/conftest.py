from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest

from tapeline import local_session

DAY, MINUTE = 86400, 60


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    spark.conf.set("spark.tapeline.chunkRows", "32")
    yield 32
    spark.conf.unset("spark.tapeline.chunkRows")


def walk(symbol: str, n: int, seed: int, step: timedelta = timedelta(minutes=1)) -> list[tuple]:
    """Random-walk bars around 100 with a gap in time, some flat bars and some bars without volume."""
    rng = random.Random(seed)
    at, price, rows = datetime(2024, 1, 1), 100.0, []
    for i in range(n):
        at += step * (30 if i == n // 2 else 1)
        o = price
        c = price = max(1.0, price + rng.gauss(0, 1))
        h, lo = max(o, c) + abs(rng.gauss(0, 0.5)), min(o, c) - abs(rng.gauss(0, 0.5))
        if i % 41 == 40:
            o = h = lo = c
        rows.append((symbol, at, o, h, max(lo, 0.5), c, float(i % 17)))
    return rows


SHAPE = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="session")
def bars(spark):
    """Three series: long, medium, and shorter than most windows; shuffled."""
    rows = walk("AAA", 400, 7) + walk("BBB", 250, 11) + walk("CCC", 6, 3)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SHAPE).cache()


@pytest.fixture(scope="session")
def frame(bars):
    """The same bars in pandas, per symbol and in order."""
    pdf = bars.toPandas().sort_values(["symbol", "ts"])
    return {k: g.reset_index(drop=True) for k, g in pdf.groupby("symbol")}


def collected(df, *order):
    """Rows as sorted tuples, with rounded numbers."""
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 8)
        return v

    return sorted([tuple(cell(v) for v in r) for r in df.collect()], key=lambda r: tuple(str(v) for v in r))
