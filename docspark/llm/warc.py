r"""WARC archives with a dictionary: written by Spark's own file writer, read back by its binary reader.

A task writes archives of about archive_bytes each, a file for each. For every one it builds a Zstandard dictionary
from the next records, puts it into a leading skippable frame (magic 0x184D2A5D, as the WARC-Zstandard convention has
it) and compresses each record as a frame of its own, so that a record can be read alone. An archive passes the target
by its last record only, so a reader's row, and what a task holds at once, is bounded by the target and one record. An
empty skippable frame ends an archive: Spark's text writer emits it as the line separator, which lets a distributed
commit protocol write binary archives to any file system Spark can reach, with no local file on any executor.

Of records with equal payloads of at least min_revisit bytes the one with the largest id is the response and the
others are revisits, which carry the headers only. The largest id of a digest is found by an aggregation of 20-byte
digests and joined back, so that a payload half of all pages share is an ordinary skewed join.

Defined results: a null payload is empty and a response; a null id is smaller than any; rows that repeat both id and
payload are all responses, as none of them is smaller; other columns are not archived. An empty table gives no
archive, which reads as an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches

DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
#: Bytes of a dictionary, and of the records it is built from.
DICT_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
MIN_REVISIT = 1000
#: Compressed bytes from which on an archive is full.
ARCHIVE_BYTES = 32 << 20
_ID = "urn:x-page:"


def record(id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; refers_to is None for a response, else (id,)."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if id is None else id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to[0]}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; payload is None in a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(_ID)) else None
    kind = fields["WARC-Type"]
    return {
        "id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": None if kind == "revisit" else payload,
    }


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained where there is enough to train on, else the records themselves as content."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archives(records: Iterable[bytes], most: int = ARCHIVE_BYTES, level: int = 3) -> Iterator[list[bytes]]:
    """The frames of each archive: the dictionary, then one for each record, until `most` bytes are reached. No records, no archives."""
    records, waiting, size = iter(records), deque(), 0
    while True:
        while size < SAMPLE_BYTES and (r := next(records, None)) is not None:
            waiting.append(r)
            size += len(r)
        if not waiting:
            return
        made = build_dictionary(list(waiting))
        raw = made.as_bytes()
        press = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
        frames = [struct.pack("<II", DICT_MAGIC, len(raw)) + raw]
        total = len(frames[0])
        while (r := waiting.popleft() if waiting else next(records, None)) is not None:
            size = max(0, size - len(r))
            frames.append(press.compress(r))
            total += len(frames[-1])
            if total >= most:
                break
        yield frames


def archive(records: Iterable[bytes], level: int = 3) -> Iterator[bytes]:
    """The frames of one archive of any size."""
    return itertools.chain.from_iterable(archives(records, 1 << 62, level))


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame, by the format's own lengths."""
    at, n = 0, len(data)
    while at < n:
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        elif magic == 0xFD2FB528:
            told = data[at + 4]
            single = told >> 5 & 1
            end = at + 5 + (not single) + (0, 1, 2, 4)[told & 3] + ((1 if single else 0), 2, 4, 8)[told >> 6]
            last = False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                last = bool(block & 1)
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 * (told >> 2 & 1)
        else:
            raise ValueError(f"no frame begins at byte {at}")
        yield magic, at, end
        at = end


def records(data: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    plain = zstandard.ZstdDecompressor()
    for magic, s, e in frames(data):
        if magic == DICT_MAGIC:
            raw = data[s + 8 : e]
            if raw[:4] == b"\x28\xb5\x2f\xfd":
                raw = zstandard.ZstdDecompressor().decompress(raw)
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        elif magic == 0xFD2FB528:
            yield plain.decompress(data[s:e])


def decide(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(id, url, payload, digest, largest): largest is the id of the response that holds an equal payload, if any."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    heads = rows.where(F.octet_length("payload") >= min_revisit).groupBy(F.col("digest").alias("_digest")).agg(F.max("id").alias("largest"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(heads, rows.digest == heads._digest, "left").drop("_digest")


def write(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z", level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives of about archive_bytes below path (on any file system that Spark reaches)."""
    bounded_batches(pages.sparkSession)

    def of(batches):
        def made():
            for b in batches:
                cols = [b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()]
                for i, u, p, d, m in zip(*cols, strict=True):
                    yield record(i, u, p, d.hex(), None if m is None or m == i else (m,), date)

        for frames in archives(made(), archive_bytes, level):
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["archive"])

    rows = decide(pages, id=id, url=url, html=html, min_revisit=min_revisit).mapInArrow(of, "archive binary")
    rows.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", SEPARATOR.decode("ascii")).text(path)


READ_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below path; a response's payload is checked against its digest and length."""

    def of(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for r in records(data):
                    x = parse(r)
                    p = x["payload"]
                    if p is not None and (len(p) != x["payload_bytes"] or hashlib.sha1(p).hexdigest() != x["payload_digest"]):
                        raise ValueError(f"record {x['id']} does not match its digest")
                    rows.append((x["id"], x["url"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], *([p] if with_payload else [])))
                    if len(rows) >= 512:
                        yield _batch(rows, with_payload)
                        rows = []
                if rows:
                    yield _batch(rows, with_payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(of, READ_SCHEMA + ", payload binary" * with_payload)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
