"""Members of archives: found by their headers, read by their ranges, decoded once.

No row holds an archive, or a member before it is decoded: rows of an index say where members lie, are dealt out by blocks
of an archive, and tasks read the ranges they name. So an archive may be of any size, and its members are decoded by many
tasks; and many small archives are opened once to find their members and once to read them, not once for each member.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBERS = "path string, member string, offset bigint, size bigint"
FRAMES = "path string, member string, n_frames int, step int, value binary"
WRITTEN = "path string, members bigint"
#: Bytes of frames, and rows, that are handed to Spark at once.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 8192
#: Bytes of an archive whose members are one task's.
BLOCK_BYTES = 8 << 20
#: Bytes that are read or written at once around headers.
BUFFER_BYTES = 16 << 10

_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(held: list[tuple], layout: str) -> pa.RecordBatch:
    names, kinds = zip(*[c.split() for c in layout.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))


def _dealt(rows: DataFrame, *by: str | Column) -> DataFrame:
    """``rows`` dealt out to all of the session's shuffle partitions, which Spark would join where rows are small.

    What a task does with a row of this module, opening a file, takes longer than its bytes tell.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as source, tarfile.open(fileobj=io.BufferedReader(source, BUFFER_BYTES), mode="r:") as archive:
                for m in archive:
                    if m.isfile():
                        held.append((path, m.name, m.offset_data, m.size))
                    if len(held) >= BATCH_ROWS:
                        yield _batch(held, MEMBERS)
                        held = []
    if held:
        yield _batch(held, MEMBERS)


def members(paths: DataFrame) -> DataFrame:
    """``path, member, offset, size`` of the files in uncompressed archives ``path``; only headers are read."""
    return _dealt(paths.select("path").distinct()).mapInArrow(_index, MEMBERS)


def _frames(batches: Iterator[pa.RecordBatch], decode: Callable[[bytes], list[bytes]], strict: bool) -> Iterator[pa.RecordBatch]:
    path = source = None
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != path:
                if source is not None:
                    source.close()
                path = row["path"]
                store, at = fs.FileSystem.from_uri(path)
                source = store.open_input_file(at)
            source.seek(row["offset"])
            content = source.read(row["size"])
            try:
                found = decode(content)
            except (ValueError, OSError, EOFError) as error:
                if strict:
                    raise ValueError(f"{row['member']} of {path} can't be decoded") from error
                continue
            if strict and not len(found):
                raise ValueError(f"{row['member']} of {path} has no frames")
            for k, frame in enumerate(found):
                held.append((path, row["member"], len(found), k, bytes(frame)))
                size += len(frame)
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield _batch(held, FRAMES)
                    held, size = [], 0
    if source is not None:
        source.close()
    if held:
        yield _batch(held, FRAMES)


def member_frames(index: DataFrame, decode: Callable[[bytes], list[bytes]], strict: bool = False) -> DataFrame:
    """``path, member, n_frames, step, value``: frames of the members of an index, each member decoded once.

    A member on which ``decode`` fails or that has no frames is an error if ``strict``, else it has no rows.
    """
    dealt = _dealt(index.select("path", "member", "offset", "size"), "path", F.floor(F.col("offset") / BLOCK_BYTES))
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(lambda batches: _frames(batches, decode, strict), FRAMES)


def camera_members(index: DataFrame, cameras: tuple[str, ...]) -> DataFrame:
    """``index`` with ``episode_id, camera``: members named ``{episode}/videos/{camera}.mp4`` of the cameras."""
    name = F.trim(F.col("member"), F.lit("/"))
    named = index.withColumns({"episode_id": F.regexp_extract(name, r"^(\d+)/", 1).try_cast("bigint"), "camera": F.regexp_extract(name, r"([^/]*)\.[^./]*$", 1)})
    return named.where(F.col("episode_id").isNotNull() & F.col("camera").isin(list(cameras)))


def aligned_frames(frames: DataFrame, keys: list[str], cameras: tuple[str, ...]) -> DataFrame:
    """``keys, step, ep_len`` and a column for each camera, for the frames that every camera has.

    ``frames`` has ``keys, camera, n_frames, step, value``. As a frame tells how many its video has, lengths need no
    second look at the frames: an episode is as long as its shortest camera.
    """
    own = lambda c, found: F.max(F.when(F.col("camera") == c, found))
    n_cameras = reduce(add, [F.coalesce(own(c, F.lit(1)), F.lit(0)) for c in cameras])
    met = frames.groupBy(*keys, "step").agg(n_cameras.alias("n_cameras"), F.min("n_frames").alias("ep_len"), *[own(c, F.col("value")).alias(c) for c in cameras])
    return met.where((F.col("n_cameras") == len(cameras)) & (F.col("step") < F.col("ep_len"))).drop("n_cameras")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = sink = None
    n, held = 0, []

    def put(data: bytes, block: int) -> None:
        sink.write(data)
        sink.write(bytes(-len(data) % block))

    def close() -> None:
        put(bytes(2 * tarfile.BLOCKSIZE), tarfile.BLOCKSIZE)
        sink.close()
        store.move(draft, at)
        held.append((path, n))

    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != path:
                if path is not None:
                    close()
                if len(held) >= BATCH_ROWS:
                    yield _batch(held, WRITTEN)
                    held.clear()
                path, n = row["path"], 0
                store, at = fs.FileSystem.from_uri(path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                draft = f"{at}.{uuid.uuid4().hex}.tmp"
                sink = store.open_output_stream(draft, buffer_size=BUFFER_BYTES)
            info = tarfile.TarInfo(row["member"])
            info.size = len(row["content"])
            sink.write(info.tobuf(tarfile.GNU_FORMAT, "utf-8"))
            put(row["content"], tarfile.BLOCKSIZE)
            n += 1
    if path is not None:
        close()
    if held:
        yield _batch(held, WRITTEN)


def write_archives(files: DataFrame) -> DataFrame:
    """Archives of the rows ``path, member, content``; ``path, members`` of what was written once it is asked for.

    An archive is one file and so one task's stream, in order of its members; it gets its name when it is whole, and a
    repeated attempt puts the same in its place.
    """
    dealt = _dealt(files.select("path", "member", "content"), "path").sortWithinPartitions("path", "member")
    return dealt.mapInArrow(_write, WRITTEN)
