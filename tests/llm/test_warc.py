"""WARC files: round trip, pushdown, foreign files, payload checks and edge cases."""

import gzip

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from episodica.llm import files, warc
from episodica.llm.shared import fresh_path


def test_round_trip_and_edge_cases(spark):
    rows = [(3, "http://x/é\r\nWARC-Type: fake", "same"), (1, "http://a/", "same"), (2, None, None), (5, " %41 ", ""), (4, "u", "é" * 50_000), (7, "u", "\r\n\r\n"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    path = fresh_path(spark, "warc-test")
    warc.write_warc(pages, path)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {
        1: ("response", None, 4), 3: ("revisit", 1, 4), 2: ("response", None, 0), 5: ("revisit", 2, 0), 4: ("response", None, 100_000), 7: ("response", None, 4), None: ("revisit", 1, 4)
    }
    assert got[4].payload.decode() == "é" * 50_000 and got[7].payload == b"\r\n\r\n" and got[3].payload is None
    assert {k: r.url for k, r in got.items()} == {p: u for p, u, _ in rows}
    empty = fresh_path(spark, "warc-test")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0
    small = fresh_path(spark, "warc-test")
    warc.write_warc(pages, small, min_bytes=5)
    assert {r.record_type for r in warc.read_warc(spark, small).collect()} == {"response"}


def test_predicates_reach_the_reader(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 3, F.lit("/")).alias("url"), (F.col("id") % 10).cast("string").alias("html"))
    path = fresh_path(spark, "warc-test")
    warc.write_warc(pages, path)
    read = warc.read_warc(spark, path)
    assert read.count() == 40 and read.where("record_type = 'response' or page_id = 13").count() == 11
    assert warc.read_warc(spark, path, record_types=["response"]).count() == 10
    prefixed = warc.read_warc(spark, path, ["revisit", "metadata"], "http://h1")
    assert prefixed.count() == read.where("url = 'http://h1/' and record_type = 'revisit'").count() > 0
    assert warc.read_warc(spark, path, headers={"WARC-Refers-To": "<urn:page:7>"}).count() == 3
    assert warc.read_warc(spark, path, payloads=False).where("payload is null").count() == 40
    for filters in ("record_type = 'response'", "url like 'http://h1%' and record_type in ('revisit', 'x')", "payload_digest is not null and page_id < 5"):
        pushed = warc.read_warc(spark, path, pushdown=True).where(filters)
        assert sorted(r.page_id for r in pushed.collect()) == sorted(r.page_id for r in read.where(filters).collect())
    reader = warc._PushdownReader(path, True, {"record_types": None, "url_prefix": None, "headers": {}})
    left = warc.EqualTo(("page_id",), 3)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), left])) == [left] and len(reader.wanted) == 1


class Spy:
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        self.data, self.got = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        out = self.data[at : at + n]
        self.got += len(out)
        return out


def records(n, size):
    import os

    return [warc.record("response", k, f"http://x/{k}", "D" * 32, size, None, os.urandom(size)) for k in range(n)]


def test_payloads_that_are_not_wanted_are_skipped():
    spy = Spy(b"".join(map(warc.gzip_member, records(5, 1_000_000))))
    assert sum(1 for _ in warc.RecordStream(spy)) == 5
    assert spy.got < spy.size() / 5
    assert [len(s.read_block()) > 1_000_000 for _, s in warc.RecordStream(spy)] == [True] * 5


@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_foreign_files(spark, pack):
    made = [warc.record("response", k, "http://x/", "", 200_000, None, b"a" * 200_000).replace(b"WARC-Payload-Digest: sha1:\r\n", b"") for k in range(3)]
    path = fresh_path(spark, "warc-test")
    store, folder = files.open_store(path)
    store.create_dir(folder)
    with store.open_output_stream(f"{folder}/x.warc{'.gz' if pack is gzip.compress else ''}", compression=None) as out:
        for r in made:
            out.write(pack(r))
    assert [(r.page_id, len(r.payload)) for r in warc.read_warc(spark, path).orderBy("page_id").collect()] == [(k, 200_000) for k in range(3)]
    assert warc.read_warc(spark, path, payloads=False).count() == 3


def test_broken_files_are_told():
    data = warc.gzip_member(records(1, 100_000)[0])
    with pytest.raises(ValueError, match="ends inside"):
        for _, stream in warc.RecordStream(pa.BufferReader(data[:-5000])):
            stream.read_block()
