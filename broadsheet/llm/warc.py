"""WARC archives: pages written as records, and read back as a table of payload chunks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.common import file_system, partitions, scratch, written

CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
RESPONSE, REVISIT = "response", "revisit"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_PAGE = "null"


def _page_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{_NO_PAGE if page_id is None else page_id}>"


def _page_of(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").rpartition(":")[2]
    return int(name) if name not in ("", _NO_PAGE) else None


def _digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload another page holds.

    Of payloads of at least ``min_bytes`` that are equal, the one with the largest ``page_id`` is
    kept; the others refer to it. Only digests and ids are shuffled. The kept page per digest
    is written first: the join then reads two plain tables, and a payload that a third of all
    pages share is split by adaptive execution.
    """
    narrow = pages.select("page_id", payload_digest().alias("digest"), F.octet_length(_html()).alias("bytes"))
    narrow = narrow.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
    kept = written(
        narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "payloads",
    )
    return narrow.join(kept, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _html():
    return F.coalesce(F.col("html"), F.lit(""))


def payload_digest():
    """SHA-1 of a page's payload in hexadecimal."""
    return F.sha1(_html().cast("binary"))


class ArchiveWriter:
    """Records, each a gzip member of its own, in one file."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.out, self.records = system.open_output_stream(path), 0

    def add(self, page_id, url, html, refers_to) -> None:
        payload = memoryview((html or "").encode())
        sha1 = hashlib.sha1(payload)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        head = {
            "WARC-Type": RESPONSE if refers_to is None else REVISIT,
            "WARC-Record-ID": _page_uri(page_id),
            "WARC-Date": DATE,
            "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-page:unknown"),
            "WARC-Payload-Digest": f"sha1:{_digest(sha1)}",
        }
        if refers_to is not None:
            head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _page_uri(refers_to)}
            payload = memoryview(b"")
        head |= {
            "Content-Type": "application/http; msgtype=response",
            "Content-Length": str(len(http) + len(payload)),
        }
        lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.out.write(packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + http))
        for at in range(0, len(payload), CHUNK):
            self.out.write(packer.compress(payload[at : at + CHUNK]))
        self.out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        self.records += 1

    def close(self) -> None:
        self.out.close()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for every row of ``pages``; returns the written table of files.

    A null ``html`` is an empty payload, a null ``url`` gets a placeholder. A row with a null
    ``page_id`` is always a response. Rows of one ``page_id`` count each: those with the kept
    id are all responses. A task writes one file under a new name, and only the names in the
    returned table count, so a task that runs again leaves no double.
    """
    again = revisits(pages, min_bytes)
    rows = (
        pages.select("page_id", "url", "html", payload_digest().alias("digest"))
        .join(again, ["page_id", "digest"], "left")
        .select("page_id", "url", "html", "refers_to")
    )

    def run(batches):
        writer, uri = None, f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                writer = writer or ArchiveWriter(uri)
                writer.add(*(v.as_py() for v in row))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [writer.records]})

    system, path = file_system(folder)
    system.create_dir(path)
    return written(rows.mapInArrow(run, "uri string, records long"), "archives")


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_records(file, chunk: int = CHUNK):
    """Chunk rows of all records of an open archive; never holds more than a chunk of a payload."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=file, mode="rb"), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(stream)
        body = int(head["content-length"])
        http_line = stream.readline()
        size = len(http_line)
        http: dict[str, str] = {}
        while True:
            line = stream.readline()
            size += len(line)
            if line in (b"\r\n", b"\n", b""):
                break
            name, _, value = line.decode("latin-1").partition(":")
            http[name.strip().lower()] = value.strip()
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
        record = {
            "record_id": head["warc-record-id"],
            "page_id": _page_of(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"],
            "refers_to": _page_of(head.get("warc-refers-to")),
        }
        left, number, done, sha1 = body - size, 0, 0, hashlib.sha1()
        if record["record_type"] == REVISIT:
            full = int(http.get("content-length", 0))
            yield record | {"chunk": 0, "data": b"", "bytes": full, "digest": declared, "last": True}
            stream.read(left)
            continue
        while True:
            data = stream.read(min(chunk, left))
            if left and not data:
                raise ValueError(f"truncated record {record['record_id']}")
            left -= len(data)
            done += len(data)
            sha1.update(data)
            so_far = _digest(sha1)
            if not left and declared and so_far != declared:
                raise ValueError(f"payload digest differs in {record['record_id']}")
            yield record | {"chunk": number, "data": data, "bytes": done, "digest": so_far, "last": not left}
            number += 1
            if not left:
                break


_CHUNKS = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("bytes", pa.int64()),
     ("digest", pa.string()), ("last", pa.bool_())]
)
CHUNK_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk long, "
    "data binary, bytes long, digest string, last boolean"
)


def read_archives(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives named in ``files.uri``.

    A payload is a row per ``chunk`` bytes (one row if it is empty): chunk number, its bytes, and
    the number of bytes and the SHA-1 digest of the payload up to its end, so the ``last`` row
    carries those of the whole payload. A revisit is one row without data, with the size and
    digest of the payload that it refers to. A digest other than the declared one is an error.
    """

    def run(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                system, path = file_system(uri)
                rows, held = [], 0
                with system.open_input_stream(path) as file:
                    for row in read_records(file, chunk):
                        rows.append(row)
                        held += len(row["data"])
                        if held >= 8 * CHUNK or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, _CHUNKS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _CHUNKS)

    spread = files.select("uri").repartition(partitions(files.sparkSession), "uri")
    return spread.mapInArrow(run, CHUNK_SCHEMA)


def archive_folder(spark) -> str:
    """A new folder for archives."""
    return scratch(spark, "archives")
