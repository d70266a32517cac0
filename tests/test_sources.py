"""Readers of folders with many files: lines keep their order from file to file."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta

import pytest

from tapeline.plans.catalog.sources_and_sinks import _through_files
from tapeline.sources import files

HEAD = "datetime,open,high,low,close,volume\n"


def _lines(first: int, count: int) -> list[str]:
    return [f"{datetime(2024, 1, 1) + timedelta(minutes=i):%Y-%m-%d %H:%M:%S},1.0,2.0,0.5,1.5,3" for i in range(first, first + count)]


def _folder(*parts: list[str]) -> str:
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, lines in enumerate(parts):
        with open(f"{folder}/part-{i:05d}.csv", "w") as f:
            f.write(HEAD + "\n".join(lines) + "\n")
    return folder


def test_order_of_time_over_many_files(spark):
    """Later files are larger, and larger files are read first; the order of the lines is that of the files all the same."""
    whole = [_lines(0, 3), _lines(3, 40), _lines(43, 6000), _lines(6043, 9)]
    assert files.read_dataset_csv(spark, _folder(*whole), "x", 6052).count() == 6052
    with pytest.raises(ValueError, match="do not increase"):
        files.read_dataset_csv(spark, _folder(whole[1], whole[0], *whole[2:]), "x")
    swapped = whole[2][:5000] + whole[2][5001:5002] + whole[2][5000:5001] + whole[2][5002:]
    with pytest.raises(ValueError, match="do not increase"):
        files.read_dataset_csv(spark, _folder(whole[0], whole[1], swapped), "x")


def test_later_file_counts(spark):
    """Of two lines of one time, that of the later file is the last, whichever file is larger."""
    one, many = _lines(5, 1)[0], _lines(0, 500)
    changed = one.replace("1.5,3", "1.25,3")
    for parts, close in (((many, [changed]), 1.25), (([changed], many), 1.5)):
        rows, about = files.load_dataset(spark, _folder(*parts), "x", "1m", policy="last")
        kept = rows.filter("ts = timestamp_ntz'2024-01-01 00:05:00'").first()
        assert kept.close == close and rows.count() == 500 and about.first().row_count == 500


def test_written_in_many_files(spark):
    """A symbol is spread over files, whose order is the order of time."""
    rows = spark.range(40000).selectExpr("CASE WHEN id % 3 = 0 THEN 'b c' ELSE 'a/b' END AS symbol", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts")
    out = rows.selectExpr("symbol", "ts AS _at", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS datetime", "1.0 AS open", "2.0 AS high", "0.5 AS low", "1.5 AS close", "3 AS volume")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = []
        back = _through_files(rows, out, lambda path, symbol: (seen.append(path), files.read_dataset_csv(spark, path, symbol))[1])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, back.groupBy("symbol").count().collect())) == [("a/b", 26666), ("b c", 13334)]
    assert spark.read.text(seen[0]).selectExpr("_metadata.file_path AS f").distinct().count() > 1
