from __future__ import annotations

import io

import pytest

from tapeline.llm.warc import BadArchive, digest, frames, parse_record, read_archives, record, train, write_archive, write_archives

PAGES = "page_id long, url string, html string, path string, records long"


def archive(payloads, dictionary):
    sink = io.BytesIO()
    write_archive(sink, (record(i, f"http://a/{i}", p, 0, i > 0 and p == payloads[0]) for i, p in enumerate(payloads)), dictionary)
    return sink.getvalue()


@pytest.mark.parametrize("payloads", [[b"<p>x</p>" * 40, b"", b"y" * 3_000_000], [b"page %d of many" % i * 9 for i in range(500)], [b""]])
def test_archives_keep_payloads(payloads):
    data = archive(payloads, train(payloads))
    got = [parse_record(x) for x in frames(io.BytesIO(data))]
    assert [g["payload"] for g in got] == payloads and [g["page_id"] for g in got] == list(range(len(payloads)))


def test_damage_is_found():
    data = archive([b"abc" * 50, b"def"], train([b"abc" * 50]))
    for bad in (data[8:], data[:-3], data[:40] + b"?" + data[41:], b"", data[:-6] + b"zzzzzz"):
        with pytest.raises(BadArchive):
            [parse_record(x) for x in frames(io.BytesIO(bad))]
    good = record(1, "u", b"payload", None, False)
    for old, new in ((b"WARC/1.1", b"WARC/9"), (b"Content-Length: 7", b"Content-Length: 6"), (b"payload\r\n", b"Payload\r\n"), (b"WARC-Date", b"X-Date"), (b"response", b"metadata")):
        with pytest.raises(BadArchive):
            parse_record(good.replace(old, new, 1))


def test_every_page_once_and_copies_refer_to_the_first(spark):
    rows = [(9, "u", "same"), (4, "v", "same"), (7, None, "same"), (1, "w", "other"), (2, "x", None), (3, "y", ""), (None, "z", "same"), (1, "w", "other"), (5, "a b", "é" * 9)]
    rows += [(100 + i, "big", "x" * 200_000) for i in range(5)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES.replace("records", "refers_to")).repartition(3)
    got = sorted(map(tuple, read_archives(write_archives(df)).collect()), key=str)
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        want.append([page, len(payload), digest(payload), "response" if page == first else "revisit", None if page == first else first])
    assert got == sorted(map(tuple, want), key=str)


def test_least_bytes_and_no_pages(spark):
    df = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0)], PAGES)
    assert {r["record_type"] for r in read_archives(write_archives(df, 3)).collect()} == {"response"}
    assert read_archives(write_archives(df.limit(0))).count() == 0
