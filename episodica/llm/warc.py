"""WARC archives as a Python data source: written with payload deduplication, read with pushdown.

Writing: each partition writes ``.warc.gz`` files of at most ``max_bytes``, one gzip member per
record, whose ``sl`` extra field holds the member's length. The commit lists them in a manifest.

Reading: one input partition per file. Predicates on record type, address and other headers are given
to the reader as options, or, with ``pushdown``, taken over from Spark's filters on the columns that
come from headers. (Spark 4.1 goes on using the filters of a DataFrame's first query in later ones
without filters, so ``pushdown`` is for a DataFrame of one query, and off by default.) A record's headers are inflated first; when they fail the predicates, or payloads are not wanted, the
reader seeks to the next member instead of inflating the rest. Archives of others, without the
extra field or with plain members, are read as well, at the price of inflating what is skipped.

Of records with equal payloads of ``min_bytes`` or more, that with the smallest ``page_id`` is a
response and the others are revisits without payload. Rows that repeat both payload and page_id of
a response are responses too. Null payloads are empty, null page ids count as the largest, a null
url is left out of the headers, and an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from episodica.llm import files
from episodica.llm.shared import fresh_path, in_small_batches, written
from episodica.sources.tables import table

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

MAX_FILE_BYTES = 256 << 20
CHUNK = 1 << 16
BATCH_BYTES = 8 << 20
_GZIP_SL = struct.Struct("<4s4sBBH2sHII")


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field ``sl`` holds its compressed and its plain length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = _GZIP_SL.size + len(body) + 8
    head = _GZIP_SL.pack(b"\x1f\x8b\x08\x04", bytes(4), 4, 255, 12, b"sl", 8, length, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def header_value(value: str) -> str:
    """A value that cannot break the header block: percent-encodes control characters and ``%``."""
    return re.sub(r"[%\x00-\x1f\x7f\x85]|^ | $", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def plain_value(value: str) -> str:
    """Inverse of ``header_value``."""
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value.encode()).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC record as plain bytes."""
    block = b"" if kind == "revisit" else HTTP_HEAD % len(payload) + payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(n_bytes)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", header_value(url)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Writes rows of ``kind, page_id, url, sha1, payload_bytes, refers_to, payload``."""

    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes = path, max_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, path = files.open_store(self.path)
        store.create_dir(path, recursive=True)
        done, out, size = _Written(), None, 0
        for batch in batches:
            for kind, page_id, url, sha1, n_bytes, refers_to, payload in zip(*batch.columns, strict=True):
                if out is None or size >= self.max_bytes:
                    if out:
                        out.close()
                    done.names.append(files.attempt_name(TaskContext.get().partitionId(), ".warc.gz"))
                    out, size = store.open_output_stream(f"{path}/{done.names[-1]}", compression=None), 0
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                data = gzip_member(record(kind.as_py(), page_id.as_py(), url.as_py(), digest, n_bytes.as_py(), refers_to.as_py(), payload.as_py()))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        files.write_manifest(self.path, {"files": sorted(n for m in messages if m for n in m.names)})

    def abort(self, messages: list[_Written | None]) -> None:
        files.delete_files(self.path, [n for m in messages if m for n in m.names])


class RecordStream:
    """Records of one file: headers first, payloads on demand."""

    def __init__(self, source):
        self.source, self.size, self.at = source, source.size(), 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], RecordStream]]:
        while self.at < self.size:
            start = self.source.read_at(min(_GZIP_SL.size, self.size - self.at), self.at)
            self.plain = start[:2] != b"\x1f\x8b"
            known = len(start) == _GZIP_SL.size and start[3] & 4 and start[12:14] == b"sl"
            self.length = _GZIP_SL.unpack(start)[7] if known else None
            self.inflate, self.next = zlib.decompressobj(31), self.at
            self.data, self.ended = bytearray(), False
            while (end := self.data.find(b"\r\n\r\n")) < 0 and not self.ended:
                self._more()
            if end < 0:
                if self.data.strip():
                    raise ValueError("a WARC record without an end of its headers")
                self.at = self.next
                continue
            lines = bytes(self.data[:end]).decode().split("\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            self.block, self.n_block = end + 4, int(headers["Content-Length"])
            yield headers, self
            self._skip()

    def _more(self) -> None:
        stop = self.at + self.length if self.length else self.size
        chunk = self.source.read_at(min(CHUNK, stop - self.next), self.next)
        self.next += len(chunk)
        if self.plain:
            self.data += chunk
            self.ended = self.next >= self.size
            return
        self.data += self.inflate.decompress(chunk)
        self.ended = self.inflate.eof
        if self.ended:
            self.next -= len(self.inflate.unused_data)
        elif not chunk:
            raise ValueError("a WARC file ends inside a record")

    def read_block(self) -> bytes:
        """The record's block."""
        while len(self.data) < self.block + self.n_block and not self.ended:
            self._more()
        return bytes(self.data[self.block : self.block + self.n_block])

    def _skip(self) -> None:
        if self.length:
            self.at += self.length
        elif self.plain:
            self.at += self.block + self.n_block + 4
        else:
            while not self.ended:
                self.data = bytearray()
                self._more()
            self.at = self.next


#: Columns that a filter can be pushed down on, and the header each comes from.
HEADER_COLUMNS = {"record_type": "WARC-Type", "url": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}
SCHEMA = pa.schema(
    [
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def page_of(record_id: str | None) -> int | None:
    """The page id of a record id of ours."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, wanted: dict):
        self.path, self.payloads, self.given, self.wanted = path, payloads, wanted, []

    def partitions(self) -> list[_File]:
        listed = files.read_manifest(self.path)
        if listed is None:
            store, path = files.open_store(self.path)
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
            names = [x.path.removeprefix(path).lstrip("/") for x in found if re.search(r"\.warc(\.gz)?$", x.path)]
            listed = {"files": sorted(names)}
        return [_File(n) for n in listed["files"]] or [_File("")]

    def passes(self, headers: dict[str, str], values: dict[str, str | None]) -> bool:
        """Do a record's headers pass the given predicates and all pushed filters?"""
        if self.given["record_types"] is not None and values["record_type"] not in self.given["record_types"]:
            return False
        if self.given["url_prefix"] is not None and not (values["url"] or "").startswith(self.given["url_prefix"]):
            return False
        if any(headers.get(name) != value for name, value in self.given["headers"].items()):
            return False
        for f in self.wanted:
            value = values[f.attribute[0]]
            good = value is not None and (
                isinstance(f, IsNotNull)
                or (isinstance(f, EqualTo) and value == f.value)
                or (isinstance(f, In) and value in f.value)
                or (isinstance(f, StringStartsWith) and value.startswith(f.value))
            )
            if not good:
                return False
        return True

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        store, path = files.open_store(self.path)
        rows, size = [], 0
        with store.open_input_file(f"{path}/{part.name}") as source:
            for headers, stream in RecordStream(source):
                url, digest = headers.get("WARC-Target-URI"), headers.get("WARC-Payload-Digest")
                values = {
                    "record_type": headers.get("WARC-Type"),
                    "url": None if url is None else plain_value(url),
                    "payload_digest": None if digest is None else digest.removeprefix("sha1:"),
                }
                if not self.passes(headers, values):
                    continue
                payload = None
                n_bytes = headers.get("X-Payload-Length")
                if self.payloads and values["record_type"] == "response":
                    payload = stream.read_block().partition(b"\r\n\r\n")[2]
                    size += len(payload)
                    n_bytes = len(payload)
                    if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != values["payload_digest"]:
                        raise ValueError(f"payload of {headers.get('WARC-Record-ID')} differs from its digest")
                rows.append(values | {"page_id": page_of(headers.get("WARC-Record-ID")), "payload_bytes": None if n_bytes is None else int(n_bytes), "refers_to": page_of(headers.get("WARC-Refers-To")), "payload": payload})
                if size >= BATCH_BYTES or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


class _PushdownReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and f.attribute[0] in HEADER_COLUMNS and len(f.attribute) == 1:
                self.wanted.append(f)
            else:
                yield f


class WarcSource(DataSource):
    """Format ``warc``. Options: ``path``; reading: ``payloads`` (true), ``predicates`` (JSON); writing: ``max_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "record_type string, page_id bigint, url string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"

    def reader(self, schema) -> _Reader:
        wanted = {"record_types": None, "url_prefix": None, "headers": {}} | json.loads(self.options.get("predicates", "{}"))
        kind = _PushdownReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], self.options.get("payloads", "true") == "true", wanted)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("max_bytes", MAX_FILE_BYTES)))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``page_id, url, html`` as WARC files under ``path``; equal payloads are stored once.

    The smallest id of each payload that occurs twice is aggregated map-side and written; pages then
    join that table on the digest, a join whose hot digests Spark can split.
    """
    pages.sparkSession.dataSource.register(WarcSource)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select(F.col("page_id").cast("long"), "url", html.alias("payload")).withColumns(
        {"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    twice = hashed.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first = written(twice.select("sha1", "payload_bytes", "first_id"), "payloads")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = in_small_batches(hashed).join(first, ["sha1", "payload_bytes"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        "page_id",
        "url",
        "sha1",
        "payload_bytes",
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    records.write.format("warc").option("path", path).mode("append").save()


def read_warc(
    spark: SparkSession,
    path: str,
    record_types: list[str] | None = None,
    url_prefix: str | None = None,
    headers: dict[str, str] | None = None,
    payloads: bool = True,
    pushdown: bool = False,
) -> DataFrame:
    """Records of a folder of WARC files: of some types, under a prefix, with some headers, or all."""
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    predicates = json.dumps({"record_types": record_types, "url_prefix": url_prefix, "headers": headers or {}})
    reader = spark.read.format("warc").option("path", path).option("payloads", str(payloads).lower())
    return reader.option("predicates", predicates).option("pushdown", str(pushdown).lower()).load()


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC files and read the records back."""
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_read_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of secure addresses, read from the archives by predicates on headers, without payloads."""
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, ["response"], "https://", payloads=False).select("page_id", "payload_bytes", "record_type")


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
         list_transform(range(8), lambda i: cast(concat('0x', substr(hex, (1 + 5 * i)::BIGINT, 5)) AS BIGINT)) AS parts
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[1 + i // 4] >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

PREDICATE_SQL = f"""
SELECT page_id, payload_bytes, record_type FROM ({OP8_SQL}) JOIN pages USING (page_id) WHERE record_type = 'response' AND url LIKE 'https://%'
"""
