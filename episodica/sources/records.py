"""Shards of framed records: a data source that reads and writes them, and episodes by enumeration.

A record is its length (8 bytes), the length's masked CRC-32C (4), the payload, and the payload's masked CRC-32C (4),
little-endian. Shards follow one another in order of their names, or as a written folder's list says; an episode's id
is its place in that order.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from episodica.functions.checksums import masked_crc32c

FORMAT = "episode_records"
RECORDS, COUNTS = "shard int, record bigint, payload binary", "shard int, records bigint"
LIST = "_shards.json"
#: Bytes of payloads that are handed to Spark at once.
BATCH_BYTES = 8 << 20


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def shard_names(uri: str) -> list[str]:
    """Paths of a folder's shards in their order."""
    store, root = _store(uri)
    if store.get_file_info(f"{root}/{LIST}").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/{LIST}") as source:
            return [f"{root}/{n}" for n in json.loads(source.read())]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _header(source, at: int, path: str, verify: bool) -> int | None:
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise ValueError(f"{path}: cut off at byte {at}")
    length, crc = struct.unpack("<QI", head)
    if verify and masked_crc32c(head[:8]) != crc:
        raise ValueError(f"{path}: wrong checksum of a length at byte {at}")
    return length


def read_records(store: fs.FileSystem, path: str, verify: bool = True) -> Iterator[bytes]:
    """Payloads of a shard, one at a time; a ``ValueError`` says where a shard is cut off or a checksum is wrong."""
    with store.open_input_stream(path) as source:
        at = 0
        while (length := _header(source, at, path, verify)) is not None:
            payload, tail = source.read(length), source.read(4)
            if len(payload) < length or len(tail) < 4:
                raise ValueError(f"{path}: cut off at byte {at}")
            if verify and masked_crc32c(payload) != struct.unpack("<I", tail)[0]:
                raise ValueError(f"{path}: wrong checksum of the payload at byte {at}")
            yield payload
            at += 16 + length


def count_records(store: fs.FileSystem, path: str) -> int:
    """Records of a shard, from their lengths alone."""
    with store.open_input_file(path) as source:
        size, at, n = source.size(), 0, 0
        while at < size:
            source.seek(at)
            at += 16 + _header(source, at, path, True)
            n += 1
        if at > size:
            raise ValueError(f"{path}: cut off at its end")
        return n


@dataclass
class Shard(InputPartition):
    """One shard and its place."""

    number: int
    path: str


class RecordReader(DataSourceReader):
    """One partition for each shard."""

    def __init__(self, options: dict):
        self.uri, self.counts = options["path"], options.get("counts", "false").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"

    def partitions(self) -> list[Shard]:
        """The shards in their order."""
        return [Shard(k, path) for k, path in enumerate(shard_names(self.uri))] or [Shard(-1, "")]

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        """Rows of a shard in batches of a bounded size, or how many there are."""
        if shard.number < 0:
            return
        store, _ = _store(self.uri)
        if self.counts:
            yield pa.RecordBatch.from_arrays([pa.array([shard.number], pa.int32()), pa.array([count_records(store, shard.path)], pa.int64())], names=["shard", "records"])
            return
        held, size, first = [], 0, 0
        for payload in read_records(store, shard.path, self.verify):
            if held and size + len(payload) > BATCH_BYTES:
                yield self._batch(shard, first, held)
                held, size, first = [], 0, first + len(held)
            held.append(payload)
            size += len(payload)
        if held:
            yield self._batch(shard, first, held)

    def _batch(self, shard: Shard, first: int, held: list[bytes]) -> pa.RecordBatch:
        numbers = pa.array([shard.number] * len(held), pa.int32())
        return pa.RecordBatch.from_arrays([numbers, pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.binary())], names=["shard", "record", "payload"])


@dataclass
class Written(WriterCommitMessage):
    """A shard that an attempt has written."""

    partition: int
    name: str
    records: int


class RecordWriter(DataSourceArrowWriter):
    """One shard for each partition, under a name of the attempt; the list names those of attempts that succeeded."""

    def __init__(self, options: dict):
        self.uri = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Write the payloads of one partition."""
        from pyspark import TaskContext

        store, root = _store(self.uri)
        store.create_dir(root, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        name = f"shard-{part:06d}-{uuid.uuid4().hex}.records"
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                for value in batch.column("payload"):
                    payload = value.as_py() or b""
                    head = struct.pack("<Q", len(payload))
                    out.write(head + struct.pack("<I", masked_crc32c(head)) + payload + struct.pack("<I", masked_crc32c(payload)))
                    n += 1
        return Written(part, name, n)

    def commit(self, messages: list[Written | None]) -> None:
        """List the shards that hold records, in order of their partitions."""
        store, root = _store(self.uri)
        store.create_dir(root, recursive=True)
        told = sorted((m.partition, m.name) for m in messages if m is not None and m.records)
        with store.open_output_stream(f"{root}/{LIST}") as out:
            out.write(json.dumps([name for _, name in told]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what was written."""
        store, root = _store(self.uri)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class RecordSource(DataSource):
    """``spark.read.format("episode_records").load(folder)``: ``shard, record, payload``, or with ``counts`` ``shard, records``."""

    @classmethod
    def name(cls) -> str:
        """The format's name."""
        return FORMAT

    def schema(self) -> str:
        """Columns by the option ``counts``."""
        return COUNTS if self.options.get("counts", "false").lower() == "true" else RECORDS

    def reader(self, schema: StructType) -> RecordReader:
        """A reader of a folder."""
        return RecordReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        """A writer of the column ``payload``."""
        if "payload" not in schema.fieldNames():
            raise ValueError("there is no column payload")
        return RecordWriter(dict(self.options))


def write_records(payloads: DataFrame, path: str) -> None:
    """Write ``payload`` of every row, in the order of partitions and of rows in them."""
    payloads.sparkSession.dataSource.register(RecordSource)
    payloads.select("payload").write.format(FORMAT).mode("append").save(path)


def numbered_records(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """``episode_id, shard, record, payload``: records by their place in all shards, from 0 without gaps.

    Places of shards are summed over one row for each shard, from lengths alone; payloads are read once, shard by shard.
    """
    spark.dataSource.register(RecordSource)
    read = spark.read.format(FORMAT).option("verify", str(verify).lower())
    counts = read.option("counts", "true").load(path)
    before = F.coalesce(F.sum("records").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", before.alias("start"))
    rows = spark.read.format(FORMAT).option("verify", str(verify).lower()).load(path)
    return rows.join(F.broadcast(starts), "shard").select((F.col("start") + F.col("record")).alias("episode_id"), "shard", "record", "payload")


def nested_episodes(records: DataFrame, schema: str) -> DataFrame:
    """``episode_id`` and the columns of ``schema``, from payloads that are JSON; a payload that is not raises."""
    parsed = F.from_json(F.col("payload").cast("string"), schema, {"mode": "FAILFAST"})
    return records.select("episode_id", parsed.alias("__e")).select("episode_id", "__e.*")
