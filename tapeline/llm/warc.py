"""WARC archives of zstd frames with a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself packed as a zstd frame. After
it comes one frame per record. A record is a WARC/1.1 header, an HTTP header and the payload; a ``revisit`` record stands
for a payload that another record holds and carries only the headers. The reader loads the dictionary, decodes frame by
frame and checks the version line, the required headers, the block length, the payload length and the digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import batches, materialize, shared_folder

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
SAMPLE_BYTES = 1 << 20  # payload bytes at the head of an archive from which its dictionary is trained
DICT_BYTES = 32 << 10
BUFFER = 1 << 20


class BadArchive(ValueError):
    """The archive is damaged or breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes]) -> zstd.ZstdCompressionDict | None:
    """A dictionary from the samples; raw content where they are too few to train one; none without any bytes."""
    joined = b"".join(samples)
    if not joined:
        return None
    try:
        return zstd.train_dictionary(DICT_BYTES, [s for s in samples if s])
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(joined[-DICT_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP header, whose Content-Length is that of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = "".join(c for c in (url or "") if c > " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean or 'urn:unknown'}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(sink, records: Iterator[bytes], dictionary: zstd.ZstdCompressionDict | None) -> int:
    """Write the dictionary frame and one frame per record; returns the number of records."""
    content = zstd.ZstdCompressor(level=9).compress(dictionary.as_bytes()) if dictionary else b""
    sink.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
    packer, n = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True), 0
    for data in records:
        sink.write(packer.compress(data))
        n += 1
    return n


def frames(source) -> Iterator[bytes]:
    """The decoded frames of an archive, read as a stream."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise BadArchive("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    content = source.read(size)
    if len(content) < size:
        raise BadArchive("the dictionary is cut short")
    dictionary = None
    if content:
        if struct.unpack("<I", content[:4])[0] == FRAME:
            content = zstd.ZstdDecompressor().decompress(content)
        dictionary = zstd.ZstdCompressionDict(content)
    unpacker, data = zstd.ZstdDecompressor(dict_data=dictionary), b""
    while True:
        data = data or source.read(BUFFER)
        if not data:
            return
        one, out = unpacker.decompressobj(), []
        try:
            while not one.eof:
                if not data and not (data := source.read(BUFFER)):
                    raise BadArchive("a frame is cut short")
                out.append(one.decompress(data))
                data = one.unused_data
        except zstd.ZstdError as e:
            raise BadArchive(str(e)) from e
        yield b"".join(out)


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record, checked: version, required headers, lengths, digest."""
    head, split, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not split or lines[0] != "WARC/1.1":
        raise BadArchive("no WARC/1.1 header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"header line without a colon: {line[:80]}")
        headers[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - headers.keys():
        raise BadArchive(f"missing headers: {sorted(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("the block length differs from Content-Length")
    http, split, payload = rest[:-4].partition(b"\r\n\r\n")
    lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not split or not http.startswith(b"HTTP/1.1 ") or len(lengths) != 1:
        raise BadArchive("no HTTP header with a length")
    kind, stated = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != lengths[0]:
            raise BadArchive("the payload length differs from the HTTP header")
        if digest(payload) != stated:
            raise BadArchive("the payload differs from its digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise BadArchive(f"not a response or a revisit without payload: {kind}")
    number = lambda urn: int(n) if (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(headers["warc-record-id"]),
        "payload_bytes": lengths[0],
        "payload_digest": stated,
        "record_type": kind,
        "refers_to": number(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload,
    }


ROWS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; returns the paths and record counts of the archives.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is a response and the
    others are revisits of it; a null html is the empty payload; rows without page_id are responses, unless an equal
    payload has an id; repeated rows with the smallest page_id are all responses. Other columns are ignored.

    Only payload digests that occur more than once are joined back, so a page with a payload of its own meets no match; a
    digest of a third of all rows is pre-aggregated to one row, and the join is one whose large partitions Spark splits.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("_sha", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    copies = slim.filter(F.col("_sha").isNotNull()).groupBy("_sha").agg(F.count("*").alias("_n"), F.min("page_id").alias("refers_to"))
    copies = materialize(copies.filter((F.col("_n") > 1) & F.col("refers_to").isNotNull()).select("_sha", "refers_to"))
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    told = slim.join(copies, "_sha", "left").select("page_id", "url", "payload", "refers_to", revisit.alias("revisit"))

    def write(source):
        source = batches(source, 512)
        held, samples, size = [], [], 0
        for batch in source:  # the head of the archive, for its dictionary
            held.append(batch)
            for payload in batch.column("payload").to_pylist():
                if size < SAMPLE_BYTES:
                    samples.append(payload)
                    size += len(payload)
            if size >= SAMPLE_BYTES:
                break
        if not held:
            return

        def records():
            while held:
                yield from held.pop(0).to_pylist()
            for batch in source:
                yield from batch.to_pylist()

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        with store.open_output_stream(f"{root}/{name}") as sink:
            n = write_archive(sink, (record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"]) for r in records()), train(samples))
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})

    done = materialize(told.mapInArrow(write, "path string, records long"))
    return done.withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record; raises on a damaged archive."""
    files = max(1, archives.count())

    def read(source):
        for batch in source:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                store, root = fs.FileSystem.from_uri(path)
                found, rows = 0, []
                with store.open_input_stream(root) as handle:
                    for data in frames(handle):
                        rows.append(parse_record(data))
                        del rows[-1]["payload"]
                        found += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=ROWS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=ROWS)
                if found != expected:
                    raise BadArchive(f"{path} has {found} records, {expected} were written")

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.repartition(files).mapInArrow(read, schema)
