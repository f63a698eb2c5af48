"""Record shards: checksums, frames written and read back, ids by enumeration, and broken files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from episodica.dataset import TrajectoryDataset
from episodica.functions.checksums import crc32c, masked_crc32c
from episodica.sources.records import nested_episodes, numbered_records, write_records


def slow_crc(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    """Published check values, and lengths around those where lanes begin."""
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0 and crc32c(b"\0" * 32) == 0x8A9136AA
    rng = random.Random(1)
    for n in (1, 255, 4095, 4096, 4097, 5000, 256 * 17, 256 * 33 + 7):
        data = rng.randbytes(n)
        assert crc32c(data) == slow_crc(data)
    assert masked_crc32c(b"") == 0xA282EAD8


def test_round_trip(spark, tmp_path):
    """Records of all sizes come back in the order of shards, numbered without gaps; empty partitions make no gap."""
    payloads = [b"", b"a", random.Random(2).randbytes(9_000_000), b"\xff" * 5000] + [str(k).encode() for k in range(200)]
    made = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(payloads)], "k int, payload binary")
    write_records(made.repartitionByRange(7, "k").sortWithinPartitions("k").union(made.limit(0)), str(tmp_path))
    got = numbered_records(spark, str(tmp_path)).collect()
    assert [bytes(r.payload) for r in sorted(got, key=lambda r: r.episode_id)] == payloads
    assert sorted(r.episode_id for r in got) == list(range(len(payloads))) and len({r.shard for r in got}) == 7


def frame(payload):
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc32c(head)) + payload + struct.pack("<I", masked_crc32c(payload))


def test_foreign_and_broken_shards(spark, tmp_path):
    """Shards of another writer are taken by name; what is cut off or changed raises."""
    for k, name in enumerate(["b-00001.records", "a-00000.records"]):
        (tmp_path / name).write_bytes(b"".join(frame(f"{k}{j}".encode()) for j in range(3)))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / "c.records").write_bytes(b"")
    found = {r.episode_id: bytes(r.payload) for r in numbered_records(spark, str(tmp_path)).collect()}
    assert found == {0: b"10", 1: b"11", 2: b"12", 3: b"00", 4: b"01", 5: b"02"}
    whole = frame(b"payload") + frame(b"more")
    for broken, verify in ((whole[:-1], True), (whole[:30], True), (whole.replace(b"more", b"mure"), True), (b"\x01" + whole[1:], True)):
        (tmp_path / "c.records").write_bytes(broken)
        with pytest.raises(Exception, match="cut off|wrong checksum"):
            numbered_records(spark, str(tmp_path), verify).collect()
    (tmp_path / "c.records").write_bytes(whole.replace(b"more", b"mure"))
    assert numbered_records(spark, str(tmp_path), verify=False).count() == 8
    (tmp_path / "none").mkdir()
    assert numbered_records(spark, str(tmp_path / "none")).count() == 0


def test_episodes_of_shards(spark, tmp_path):
    """Nested episodes written as records are a dataset of steps."""
    steps = [[{"x": float(10 * e + s), "action": [1.0]} for s in range(n)] for e, n in enumerate([3, 0, 2])]
    rows = spark.createDataFrame([(e, s) for e, s in enumerate(steps)], "e int, steps array<struct<x:double,action:array<float>>>")
    write_records(rows.orderBy("e").select(F.to_json(F.struct("steps")).cast("binary").alias("payload")), str(tmp_path))
    schema = "steps array<struct<x:double,action:array<float>>>"
    data = TrajectoryDataset.from_records(spark, str(tmp_path), schema, ["x"])
    assert sorted((r.episode_id, r.step, r.observation.x) for r in data.steps.collect()) == [(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (2, 0, 20.0), (2, 1, 21.0)]
    bad = spark.createDataFrame([(bytearray(b"{"),)], "payload binary")
    write_records(bad, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        nested_episodes(numbered_records(spark, str(tmp_path / "bad")), schema).collect()
