"""Members of archives by their ranges: only what is wanted is read, and decoded once."""

import io
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from episodica.sources.archives import camera_members, member_frames, members
from episodica.sources.video import read_videos


def archive(path, files):
    path.parent.mkdir(parents=True, exist_ok=True)
    with tarfile.open(path, "w") as out:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            out.addfile(info, io.BytesIO(content))


@pytest.fixture
def root(tmp_path):
    long = "deep/" * 40
    archive(tmp_path / "observations/5/10-11.tar", {"10/videos/head.mp4": b"abc", "10/videos/hand.mp4": b"xy", "10/note.txt": b"n", "11/videos/head.mp4": b"d", "11/videos/hand.mp4": b"zw"})
    archive(tmp_path / "observations/5/12-19.tar", {"12/videos/head.mp4": b"", f"{long}x.mp4": b"7" * 3000, "13/videos/head.mp4": b"efgh", "13/videos/hand.mp4": b"1234"})
    archive(tmp_path / "observations/6/10-10.tar", {"10/videos/hand.mp4": b"PQ", "10/videos/head.mp4": b"QR"})
    return tmp_path


def test_index(spark, root):
    paths = spark.createDataFrame([(str(p),) for p in sorted(root.rglob("*.tar"))] * 2, "path string")
    found = members(paths).collect()
    assert len(found) == 11 and len({(r.path, r.member) for r in found}) == 11
    for r in found:
        with open(r.path, "rb") as f:
            f.seek(r.offset)
            content = f.read(r.size)
        with tarfile.open(r.path) as a:
            assert a.extractfile(r.member).read() == content
    assert {(r.episode_id, r.camera) for r in camera_members(members(paths), ("head",)).collect()} == {(10, "head"), (11, "head"), (12, "head"), (13, "head")}


def decoder(log):
    """Frames are a video's bytes; every call leaves a line in a file."""

    def decode(content):
        with open(log, "a") as f:
            f.write(f"{content!r}\n")
        if content.startswith(b"7"):
            raise ValueError("not a video")
        return [bytes([b]) for b in content]

    return decode


def test_videos_are_read_once(spark, root, tmp_path):
    """Both cameras of the wanted episodes are decoded once each, no other video is read, and ids of two tasks may be alike."""
    listing = spark.createDataFrame([(k, p) for k, p in enumerate(["observations/5/10-11.tar", "observations/5/12-19.tar", "observations/6/10-10.tar", "task_info/task_5.json"])], "position int, path string")
    tasks = spark.createDataFrame([(5, 10, "fold"), (5, 13, "fold"), (6, 10, "pour")], "task_id long, episode_id long, task_name string")
    log = tmp_path / "calls"
    steps = read_videos(tasks, listing, str(root), decoder(str(log)), ("head", "hand")).collect()
    got = sorted((r.episode_id, r.step, r.ep_len, bytes(r.head), bytes(r.hand), r.language_instruction) for r in steps)
    assert got == [
        (0, 0, 2, b"a", b"x", "fold"), (0, 1, 2, b"b", b"y", "fold"),
        (1, 0, 4, b"e", b"1", "fold"), (1, 1, 4, b"f", b"2", "fold"), (1, 2, 4, b"g", b"3", "fold"), (1, 3, 4, b"h", b"4", "fold"),
        (2, 0, 2, b"Q", b"P", "pour"), (2, 1, 2, b"R", b"Q", "pour"),
    ]
    assert sorted(log.read_text().split()) == sorted(map(repr, [b"abc", b"xy", b"efgh", b"1234", b"QR", b"PQ"]))
    with pytest.raises(Exception, match="no archive holds 1"):
        read_videos(tasks.union(spark.createDataFrame([(7, 1, "x")], tasks.schema)), listing, str(root), decoder(str(log)), ("head",))
    with pytest.raises(Exception, match="has no frames"):
        read_videos(spark.createDataFrame([(5, 12, "fold")], tasks.schema), listing, str(root), decoder(str(log)), ("head",)).collect()


def test_frames_that_fail(spark, root, tmp_path):
    index = members(spark.createDataFrame([(str(root / "observations/5/12-19.tar"),)], "path string"))
    decode = decoder(str(tmp_path / "calls"))
    kept = member_frames(index, decode).groupBy("member").agg(F.count("*").alias("n"), F.max("n_frames").alias("told")).collect()
    assert {r.member: (r.n, r.told) for r in kept} == {"13/videos/head.mp4": (4, 4), "13/videos/hand.mp4": (4, 4)}
    with pytest.raises(Exception, match="can't be decoded|has no frames"):
        member_frames(index, decode, strict=True).collect()


def test_many_small_archives(spark, tmp_path, monkeypatch):
    """Archives are opened once for their headers and once for their frames, by many tasks, and come in few batches."""
    from episodica.sources import archives

    paths = [f"{tmp_path}/{k}/0-9.tar" for k in range(50)]
    long = "deep/" * 60
    wanted = {(p, f"{e}/videos/{c}.mp4"): f"{k} {e} {c}".encode() for k, p in enumerate(paths) for e in (*range(5), long) for c in ("head", "hand")}
    rows = [pa.RecordBatch.from_pylist([{"path": p, "member": m, "content": c}]) for (p, m), c in sorted(wanted.items())]
    written = list(archives._write(iter(rows)))
    assert len(written) == 1 and [(r["path"], r["members"]) for r in written[0].to_pylist()] == [(p, 12) for p in sorted(paths)]
    for p in paths:
        with tarfile.open(p) as a:
            assert {(p, m.name): a.extractfile(m).read() for m in a} == {k: v for k, v in wanted.items() if k[0] == p}

    opened, real = [], archives.fs.FileSystem

    class Counted:
        @staticmethod
        def from_uri(path):
            opened.append(path)
            return real.from_uri(path)

    index = list(archives._index(iter([pa.RecordBatch.from_pydict({"path": paths})])))
    assert len(index) == 1 and index[0].num_rows == len(wanted)
    found = members(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert found.select("path", F.spark_partition_id().alias("task")).groupBy("task").count().count() == 4
    frames = archives.member_frames(spark.createDataFrame(index[0].to_pylist()), lambda content: [content[k : k + 1] for k in range(len(content))])
    assert frames.select(F.spark_partition_id()).distinct().count() == 4
    got = {}
    for r in frames.orderBy("path", "member", "step").collect():
        got[r.path, r.member] = got.get((r.path, r.member), b"") + bytes(r.value)
    assert got == wanted
    monkeypatch.setattr(archives.fs, "FileSystem", Counted)
    ordered = pa.RecordBatch.from_pylist(sorted(index[0].to_pylist(), key=lambda r: (r["path"], r["offset"])))
    batches = list(archives._frames(iter([ordered]), lambda content: [content], True))
    assert opened == sorted(paths) and len(batches) == 1 and batches[0].num_rows == len(wanted)


def test_batches_end_at_a_number_of_rows_and_bytes(tmp_path, monkeypatch):
    from episodica.sources import archives

    path = str(tmp_path / "7/0-9.tar")
    files = [{"path": path, "member": f"{k}/videos/head.mp4", "content": bytes([k]) * 5} for k in range(7)]
    monkeypatch.setattr(archives, "BATCH_ROWS", 3)
    assert [b.num_rows for b in archives._write(iter([pa.RecordBatch.from_pylist(files)]))] == [1]
    index = list(archives._index(iter([pa.RecordBatch.from_pydict({"path": [path]})])))
    assert [b.num_rows for b in index] == [3, 3, 1]
    monkeypatch.setattr(archives, "BATCH_BYTES", 2)
    frames = list(archives._frames(iter(index), lambda content: [content[:1]] * 2, True))
    assert [b.num_rows for b in frames] == [2] * 7
    assert [r["step"] for b in frames for r in b.to_pylist()] == [0, 1] * 7


def test_listing_of_archives_stays_off_the_driver(spark, sf, monkeypatch):
    """The query's archives are as many as its input: their names are no list of the driver."""
    from pyspark.sql import DataFrame

    from episodica.plans import source_queries

    def refused(self):
        raise AssertionError("rows of archives on the driver")

    monkeypatch.setattr(DataFrame, "collect", refused)
    assert source_queries.archive_video_steps(spark, sf).count() > 0
