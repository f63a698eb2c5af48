"""Operators against fixed values and brute-force models."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.dataset import TrajectoryDataset
from episodica.functions import names, render
from episodica.operators import episodes, schema, selection
from episodica.operators.tubelets import TubeletGrid, tubelet_steps
from episodica.operators.windows import TemporalWindow, dense_windows, gather
from episodica.sources import catalog, tasks
from episodica.sources.store import EpisodeStore
from episodica.sources.tabular import tabular_steps
from episodica.streaming.ingest import ingest


def made_steps(spark, lengths):
    rows = [(e, s, n, float(100 * e + s)) for e, n in enumerate(lengths) for s in range(n)]
    return spark.createDataFrame(rows, "episode_id long, step int, ep_len int, state double").repartition(3)


@pytest.mark.parametrize(
    ("length", "anchor", "deltas", "want", "want_next"),
    [(5, 2, [-0.1, 0.0], [1, 2], [2, 3]), (3, 2, [-0.1, 0.0], [1, 2], [2, 2]), (3, 0, [-0.5, 0.0], [0, 0], [0, 2])],
)
def test_window_values(spark, length, anchor, deltas, want, want_next):
    window = TemporalWindow({"state": deltas})
    leaves = {"state": window.offsets("state")}
    steps = made_steps(spark, [length])
    got = dense_windows(steps, leaves).where(F.col("step") == anchor).first()
    after = dense_windows(steps, {"state": window.next_offsets("state")}).where(F.col("step") == anchor).first()
    assert list(got.state) == want and list(after.state) == want_next


@pytest.mark.parametrize("seed", range(3))
def test_windows_against_a_model(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 9) for _ in range(12)]
    offsets = [rng.randrange(-10, 11) for _ in range(4)]
    steps = made_steps(spark, lengths)
    clamp = lambda e, s: float(100 * e + max(0, min(lengths[e] - 1, s)))
    want = {(e, s): [clamp(e, s + k) for k in offsets] for e, n in enumerate(lengths) for s in range(n)}
    assert {(r.episode_id, r.step): list(r.state) for r in dense_windows(steps, {"state": offsets}).collect()} == want
    anchors = steps.select(F.monotonically_increasing_id().alias("b"), "episode_id", F.col("step").alias("anchor_step"), "ep_len")
    found = gather(steps, anchors, offsets, ["state"]).collect()
    assert {(r.episode_id, r.anchor_step, r.t): r.state for r in found} == {(e, s, t): v for (e, s), vs in want.items() for t, v in enumerate(vs)}


def test_nulls_are_values(spark):
    rows = [(0, 0, 3, 1.0), (0, 1, 3, None), (0, 2, 3, 3.0)]
    steps = spark.createDataFrame(rows, "episode_id long, step int, ep_len int, state double")
    got = {r.step: list(r.state) for r in dense_windows(steps, {"state": [-1, 0, 1]}).collect()}
    assert got == {0: [1.0, 1.0, None], 1: [1.0, None, 3.0], 2: [None, 3.0, 3.0]}
    found = episodes.to_transitions(steps, ["state"]).select("step", "next.observation.state").collect()
    assert {r.step: r.state for r in found} == {0: None, 1: 3.0, 2: 3.0}


@pytest.mark.parametrize(
    ("length", "grid", "want"),
    [(10, TubeletGrid(1, 3, 0.2), [[5, 7, 9]]), (10, TubeletGrid(3, 3, 0.2), [[0, 2, 4], [2, 4, 6], [5, 7, 9]]), (3, TubeletGrid(2, 4, 0.1), [[0, 1, 2, 2]] * 2)],
)
def test_tubelets(spark, length, grid, want):
    found = tubelet_steps(spark.createDataFrame([(0, length)], "episode_id long, ep_len int"), grid).collect()
    assert [[r.step for r in sorted(found, key=lambda r: r.t) if r.clip == c] for c in range(grid.clips)] == want


def test_numbering_by_stretches_is_the_same(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("u"), F.col("id").alias("t"))
    plain = episodes.number_steps(rows, "u", ["t"])
    cut = episodes.number_steps(rows, "u", ["t"], F.floor(F.col("t") / 50))
    columns = ["u", "t", "step", "ep_len"]
    assert sorted(plain.select(columns).collect()) == sorted(cut.select(columns).collect())


def test_last_run_wins(spark):
    rows = spark.createDataFrame(list(enumerate([1, 1, 2, 1, 1, 1])), "i long, e long")
    assert {tuple(r) for r in episodes.last_run_index(rows, "e", "i").collect()} == {(1, 3, 3), (2, 2, 1)}


def test_nested_episodes(spark):
    steps = [[(float(e), [float(e), float(t)], float(t), t == 2, t == 2, "pick up the block") for t in range(3)] for e in range(5)]
    kind = "episode_id long, steps array<struct<state: double, action: array<double>, reward: double, is_last: boolean, is_terminal: boolean, language_instruction: string>>"
    data = TrajectoryDataset.from_nested(spark.createDataFrame([*enumerate(steps), (9, [])], kind), ["state"])
    assert (data.num_episodes(), data.num_steps()) == (5, 15)
    assert data.select([0, 1, 1]).num_steps() == 6
    with pytest.raises(ValueError, match="77"):
        data.select([0, 77])
    assert data.modalities() == {"text": ["language_instruction"], "state": ["next/observation/state", "observation/state"], "action": ["action"]}
    batch = data.with_windows({"action": [0.0, 0.1]}).sample(4, seed=1)
    assert {"action", "next/action", "observation/state", "next/observation/state", "language_instruction", "done"} <= set(batch.columns)
    assert batch.count() == 4 and {len(r["action"]) for r in batch.collect()} == {2}
    assert sorted(map(str, batch.collect())) == sorted(map(str, data.with_windows({"action": [0.0, 0.1]}).sample(4, seed=1).collect()))
    clips = data.with_sampler(TubeletGrid(2, 2, 0.1)).sample(seed=3)
    assert clips.count() == 4 and clips.select("episode_id").distinct().count() == 1
    assert next(data.batches(2)).count() == 2
    assert schema.leaf_column("a/b") is not None
    with pytest.raises(KeyError):
        schema.require_leaf(data.steps, "observation/nothing")


def test_tabular_rows(spark):
    rows = spark.createDataFrame(
        [(e, t, [float(e)] * 4, [float(e), float(t)], float(t), t == 2, t == 2, t * 0.1, e % 2) for e in range(5) for t in (2, 0, 1)],
        "episode_index long, frame_index long, `observation.state` array<double>, action array<double>, `next.reward` double, `next.done` boolean,"
        " `next.terminated` boolean, timestamp double, task_index long",
    )
    steps = tabular_steps(rows)
    assert set(steps.columns) == {"episode_id", "step", "ep_len", "observation", "action", "reward", "is_last", "is_terminal"}
    assert TrajectoryDataset.from_tabular(rows, tasks=[0]).num_steps() == 9
    assert TrajectoryDataset.from_tabular(rows, tasks=[1]).num_episodes() == 2
    assert TrajectoryDataset.from_tabular(rows, tasks=[0], episodes=[0]).num_steps() == 3
    with pytest.raises(ValueError, match="no such"):
        TrajectoryDataset.from_tabular(rows, tasks=[0], episodes=[1])
    with pytest.raises(ValueError, match="task"):
        selection.filter_tasks(rows.drop("task_index"), [0])
    with pytest.raises(ValueError, match="episode_index"):
        tabular_steps(rows.drop("episode_index"))


def test_archives_and_maps(spark):
    paths = ["task_info/task_100.json", "task_info/task_200.json", "task_info/task_x.json", "observations/100/1000-1020.tar", "observations/200/2000-2010.tar"]
    listed = spark.createDataFrame(list(enumerate(paths)), "position long, path string")
    assert [r.task_id for r in tasks.task_ids(listed).collect()] == [100, 200]
    wanted = spark.createDataFrame([(100, 1000), (100, 1010), (100, 1020), (200, 2000), (200, 2010)], "task_id long, episode_id long")
    found = selection.find_archives(wanted, selection.archives_of(listed))
    assert {(r.episode_id, r.path) for r in found.collect()} >= {(1010, paths[3]), (2010, paths[4])}
    with pytest.raises(ValueError, match="1 of"):
        selection.require_archives(selection.find_archives(wanted.limit(1).selectExpr("task_id", "9999L as episode_id"), selection.archives_of(listed)))
    known = selection.global_episode_map(wanted.where("task_id = 200"))
    extended = selection.extend_episode_map(known, wanted)
    assert sorted(tuple(r) for r in extended.collect()) == [(0, 200, 2000), (1, 200, 2010), (2, 100, 1000), (3, 100, 1010), (4, 100, 1020)]


def test_decoding_archives(spark):
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, data in (("7/videos/head_color.mp4", b"abc"), ("7/videos/hand_left_color.mp4", b"ab"), ("7/videos/other.mp4", b"x"), ("8/videos/head_color.mp4", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))

    def decode(video):
        if not video:
            raise ValueError("no frames")
        return [bytes([b]) for b in video]

    frames = tasks.decode_frames(spark.createDataFrame([("a.tar", out.getvalue())], "path string, content binary"), decode).cache()
    assert sorted((r.episode_id, r.camera, r.step) for r in frames.collect()) == [(7, "hand_left_color", 0), (7, "hand_left_color", 1), *[(7, "head_color", k) for k in range(3)]]
    cameras = {c: frames.where(F.col("camera") == c) for c in ("head_color", "hand_left_color")}
    assert selection.align_cameras(cameras).count() == 2


def test_video_episodes(spark, tmp_path):
    rows = [(100, e, "fold") for e in (1000, 1010, 1020)] + [(200, e, "stack") for e in (2000, 2010)]
    known = spark.createDataFrame(rows, "task_id long, episode_id long, task_name string")
    frames = {c: known.select("episode_id", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step"), F.lit(b"\0" * 192).alias("value")) for c, n in (("head_color", 4), ("hand_left_color", 5))}
    data = TrajectoryDataset.from_video(known, frames)
    assert (data.num_episodes(), data.num_steps(), data.control_frequency) == (5, 25, 30.0)
    assert TrajectoryDataset.from_video(known, frames, [100]).num_steps() == 15
    assert data.image_keys() == ["next/observation/hand_left_color", "next/observation/head_color", "observation/hand_left_color", "observation/head_color"]
    first = data.steps.where("episode_id = 3 and step = 4").first()
    assert (list(first["action"]), first.done, first.language_instruction) == ([0.0], True, "stack")
    kept = selection.global_episode_map(known)
    selection.save_episode_map(kept, str(tmp_path / "map"))
    assert sorted(selection.load_episode_map(spark, str(tmp_path / "map")).collect()) == sorted(kept.collect())


def test_reading_videos(spark, tmp_path):
    import io
    import tarfile

    from episodica.sources.video import read_videos

    (tmp_path / "observations/100").mkdir(parents=True)
    for name, episode in (("1000-1010.tar", 1000), ("1011-1020.tar", 1011)):
        with tarfile.open(tmp_path / "observations/100" / name, "w") as archive:
            info = tarfile.TarInfo(f"{episode}/videos/head_color.mp4")
            info.size = 3
            archive.addfile(info, io.BytesIO(b"abc"))
    known = spark.createDataFrame([(100, 1000, "fold")], "task_id long, episode_id long, task_name string")
    paths = spark.createDataFrame([(0, "observations/100/1000-1010.tar"), (1, "observations/100/1011-1020.tar")], "position long, path string")
    steps = read_videos(known, paths, str(tmp_path), lambda v: [bytes([b]) for b in v], ("head_color",))
    assert sorted((r.episode_id, r.step, bytes(r.head_color)) for r in steps.collect()) == [(0, 0, b"a"), (0, 1, b"b"), (0, 2, b"c")]


def test_rendering(spark):
    clips = spark.range(3).select(F.col("id").alias("clip"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("t")).withColumn(
        "image", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: (k * 3 + F.col("clip") * 50 + F.col("t") * 7).cast("double"))
    )
    made = render.batch_gif(clips, "image", (4, 5, 3))
    assert made[6:10] == bytes([14, 0, 12, 0]) and made.count(b"\x21\xf9\x04") == 2
    assert render.item_gif(clips, 1, "image", (4, 5, 3))[6:10] == bytes([5, 0, 4, 0])
    with pytest.raises(IndexError):
        render.item_gif(clips, 9, "image", (4, 5, 3))
    steps = clips.select(F.col("clip").alias("episode_id"), F.col("t").alias("step"), "image")
    assert render.episode_gif(steps, {"image": (4, 5, 3)}, -1)[6:10] == bytes([5, 0, 4, 0])
    with pytest.raises(IndexError):
        render.episode_gif(steps, {"image": (4, 5, 3)}, 3)
    with pytest.raises(ValueError, match="no frames"):
        render.batch_gif(clips, "image", (9, 9, 3))
    with pytest.raises(ValueError, match="channels"):
        render.batch_gif(clips, "image", (4, 5, 2))


def test_colours_of_both_layouts(spark):
    """Red, green and blue keep their places; one channel gives gray."""
    pixels = np.zeros((2, 2, 3))
    pixels[0, 0], pixels[0, 1], pixels[1, 0] = (1, 0, 0), (0, 1, 0), (0, 0, 1)
    want = [255 if v else 0 for v in pixels.ravel()]
    for flat, shape in ((pixels, (2, 2, 3)), (pixels.transpose(2, 0, 1), (3, 2, 2))):
        clips = spark.createDataFrame([(0, 0, flat.ravel().tolist())], "clip int, t int, image array<double>")
        assert render.colour_frames(clips, "image", shape).first().rgb == want
    gray = spark.createDataFrame([(0, 0, [0.0, 1.0, 1.0, 0.0])], "clip int, t int, image array<double>")
    rgb = render.colour_frames(gray, "image", (2, 2, 1)).first().rgb
    assert rgb[:3] == [0, 0, 0] and rgb[3] == rgb[4] == rgb[5] > 200
    assert render.palette_codes(np.array([[[0, 0, 0], [255, 255, 255]]])).tolist() == [[0, 251]]


def test_skills(spark):
    segments = spark.createDataFrame([(1, 0, 0, 5, "a"), (1, 1, 3, 8, "b"), (1, 2, None, 20, "c")], "episode_id long, position int, start_frame int, end_frame int, action_text string")
    frames = spark.range(25).select(F.lit(1).cast("long").alias("episode_id"), F.col("id").cast("int").alias("step"))
    got = {r.step: r.skill for r in selection.skill_at(frames, segments).collect()}
    assert [got[k] for k in (0, 4, 5, 7, 8, 19, 20)] == ["a", "a", "b", "b", "c", "c", ""]


def test_catalog(spark):
    paths = [("droid/1.0.0/x",), ("/droid/1.0.1/y/z/",), ("kuka/0.9/a",), ("kuka/0.10/a",), ("plain",)]
    known = catalog.Catalog(lambda: spark.createDataFrame(paths, "path string"))
    assert known.path("droid/") == "droid/1.0.1" and known.path("kuka") == "kuka/0.10" and known.path("plain") == "plain"
    assert known.validate("kuka", "0.9") and not known.validate("kuka", "1") and not known.validate("none")
    with pytest.raises(ValueError, match="0.10"):
        known.path("kuka", "7")
    known.entries(refresh=True)


def test_listing(spark, tmp_path):
    for name in ("a/1/x.bin", "b/2/y.bin"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(b"1")
    assert sorted(r.path for r in catalog.listing(spark, str(tmp_path)).collect()) == ["a/1/x.bin", "b/2/y.bin"]


def test_kinds_and_text():
    want = {"observation/keyframe": "image", "context": "text", "observation/gripper_velocity": "action", "wheel": "state", "next/reward": "generic"}
    assert {k: names.kind_of_name(k) for k in want} == want


def test_bytes_as_text(spark):
    got = spark.createDataFrame([(b"ok \xc3\xa9",), (b"\xff\xfe",)], "b binary").select(names.utf8_or_null(F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == ["ok é", None]


def test_store_is_incremental(spark, tmp_path):
    steps = made_steps(spark, [3, 2, 4])
    store = EpisodeStore(spark, str(tmp_path))
    ids = lambda *e: spark.createDataFrame([(k,) for k in e], "episode_id long")
    store.build(steps, ids(0, 1), "first")
    assert not store.is_stored(ids(0, 2)) and store.is_stored(ids(1))
    store.build(steps, ids(1, 2, 2), "second")
    assert sorted(r.flat_index for r in store.read().collect()) == list(range(9))
    assert sorted((r.episode_id, r.flat_index) for r in store.read(ids(0, 2)).collect())[-1] == (2, 6)
    with pytest.raises(ValueError, match="not stored"):
        store.read(ids(5))
    with pytest.raises(ValueError, match="no episodes"):
        store.read(ids(0).limit(0))


def test_stream_into_the_store(spark, tmp_path):
    steps = made_steps(spark, [3, 2])
    for e in (0, 1):
        steps.where(F.col("episode_id") == e).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = EpisodeStore(spark, str(tmp_path / "store"))
    ingest(stream, store, str(tmp_path / "state")).awaitTermination()
    assert store.read().count() == 5
    store.build(steps, steps.select("episode_id"), "again")
    assert store.read().count() == 5


def test_a_second_stream_into_the_same_store(spark, tmp_path):
    """Its batches have the first one's numbers, but steps of their own."""
    steps = made_steps(spark, [3, 2, 4])
    store = EpisodeStore(spark, str(tmp_path / "store"))
    for n, chosen in enumerate(("episode_id < 2", "episode_id > 0", "episode_id > 0")):
        steps.where(chosen).write.parquet(str(tmp_path / f"in-{n}"))
        stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / f"in-{n}"))
        ingest(stream, store, str(tmp_path / f"state-{n}")).awaitTermination()
    assert sorted(r.flat_index for r in store.read().collect()) == list(range(9))


@pytest.mark.parametrize("ids", [[], [7], [3, -2, 3, None, 10**12], list(range(25_000))])
def test_selection_key(spark, ids):
    """The digest of the sorted, distinct ids, however many batches they come in."""
    listed = ",".join(map(str, sorted({i for i in ids if i is not None})))
    got = selection.selection_key(spark.createDataFrame([(i,) for i in ids], "episode_id long")).first()
    assert got.selection_key == hashlib.md5(listed.encode()).hexdigest()[:16]
    assert got.n_episodes == len({*ids} - {None})


def test_gif_frames():
    image = pytest.importorskip("PIL.Image")
    import io

    levels = [[k * 255 // (n - 1) for k in range(n)] for n in render.LEVELS]
    rng = np.random.default_rng(2)
    frames = [np.stack([rng.choice(x, (15, 20)) for x in levels], -1).astype(np.uint8) for _ in range(3)]
    opened = image.open(io.BytesIO(render.gif(frames)))
    assert opened.n_frames == 3
    for k, frame in enumerate(frames):
        opened.seek(k)
        assert (np.array(opened.convert("RGB")) == frame).all()


def test_gif_shape():
    made = render.gif([np.zeros((32, 16, 3), np.uint8)] * 4)
    assert made.startswith(b"GIF89a") and made.endswith(b"\x3b") and made[6:10] == bytes([16, 0, 32, 0])


def test_builds_and_streams_that_stop_and_repeat(spark, tmp_path):
    """A write that ends before the manifest is not seen; repeated ones and split episodes give each step once."""
    steps = made_steps(spark, [3, 2, 4])
    everyone = steps.select("episode_id").distinct()

    class Stopped(EpisodeStore):
        def _name(self, part, batch, fresh):
            raise RuntimeError("stopped")

    root = str(tmp_path / "store")
    with pytest.raises(RuntimeError):
        Stopped(spark, root).build(steps, everyone, "b")
    store = EpisodeStore(spark, root)
    assert store.manifest().count() == 0
    for _ in range(2):
        store.build(steps, everyone, "b")
    assert store.read().count() == 9 and {r.n_steps for r in store.manifest().collect()} == {2, 3, 4}
    other = EpisodeStore(spark, str(tmp_path / "parts"))
    with pytest.raises(RuntimeError):
        Stopped(spark, other.root).append(steps.where("step < 2"), "0")
    other.append(steps.where("step < 2"), "0")
    other.append(steps.where("step < 2"), "0")
    other.append(steps.where("step >= 1"), "1")
    assert sorted((r.episode_id, r.step) for r in other.read().collect()) == sorted((r.episode_id, r.step) for r in steps.collect())
    assert sorted(r.flat_index for r in other.read().collect()) == [*range(9)]
    assert other.read(everyone.where("episode_id = 1")).count() == 2
    other.delete()
    assert other.manifest().count() == 0


def test_sparse_ids(spark):
    """Ids far apart are indexed in order in a bounded number of ranges."""
    ids = [-(2**62), -5, 0, 7, 2**40, 2**62, 2**62 + 1]
    steps = spark.createDataFrame([(e, s, 2) for e in ids for s in (0, 1)], "episode_id long, step int, ep_len int")
    got = {r.episode_id: r.ep_start for r in episodes.episode_index(steps).collect()}
    assert got == {e: 2 * k for k, e in enumerate(ids)}
    assert {r.episode_id: r.ordinal for r in episodes.episode_ordinals(steps).collect()} == {e: k for k, e in enumerate(ids)}


def test_handles(spark, tmp_path):
    """Stores behind a handle, kept maps, config and splits."""
    steps = made_steps(spark, [3, 2, 4])
    store = EpisodeStore(spark, str(tmp_path / "store"))
    store.build(steps, steps.select("episode_id").distinct(), "b")
    plain, stored = TrajectoryDataset(steps), TrajectoryDataset.from_store(store)
    assert stored.num_episodes() == 3 and stored.num_steps() == 9 and stored.info()["steps"] == 9
    rows = lambda d: sorted((r.b, r.episode_id, r.anchor_step) for r in d.sample(16, 5).collect())
    assert rows(plain) == rows(stored) and len(rows(plain)) == 16
    grid = plain.with_config({"control_frequency": 5.0, "sampler": {"kind": "TubeletGrid", "clips": 2, "frames": 2, "spacing": 0.1, "control_frequency": 10.0}})
    assert grid.with_config(grid.config()).config() == grid.config() and grid.sample(seed=3).count() == 4
    parts = plain.splits({"a": 0.5, "b": 0.5})
    assert sum(p.num_steps() for p in parts.values()) == 9
    tasks = spark.createDataFrame([(2, 20, "x"), (5, 50, "y")], "task_id long, episode_id long, task_name string")
    frames = spark.createDataFrame([(20, 0, 1.0), (50, 0, 2.0)], "episode_id long, step int, value double")
    ids = lambda chosen: [r.episode_id for r in TrajectoryDataset.from_video(tasks, {"head": frames}, chosen, str(tmp_path / "map")).steps.collect()]
    assert ids([5]) == [0] and ids([2]) == [1] and ids([5]) == [0] and sorted(ids(None)) == [0, 1]


def test_images_come_channels_first(spark):
    """Flat 8 x 8 x 3 images of windows, of anchors and of tubelets in CHW order."""
    flat = [float(k) for k in range(192)]
    want = np.array(flat).reshape(8, 8, 3).transpose(2, 0, 1).ravel().tolist()
    rows = spark.createDataFrame([(e, s, 3, flat) for e in (0, 1) for s in range(3)], "episode_id long, step int, ep_len int, image array<double>")
    image = F.col("image").alias("image", metadata={"shape": [8, 8, 3]})
    steps = rows.select("episode_id", "step", "ep_len", F.struct(image).alias("observation"))
    data = TrajectoryDataset(steps).with_windows({"observation/image": [-0.1, 0.0, 0.1]})
    for row in data.sample(5, 1).collect():
        assert row["observation/image"] == [want] * 3 == row["next/observation/image"]
    clips = data.with_config({"control_frequency": 10.0, "sampler": {"kind": "TubeletGrid", "clips": 1, "frames": 2, "spacing": 0.1, "control_frequency": 10.0}})
    assert [r.observation.image for r in clips.sample(seed=2).collect()] == [want] * 2


def test_direct_lookup(spark, tmp_path):
    """One dataset is found in its own folder without the listing of all."""
    for name in ("a/1.2/x.bin", "a/1.10/x.bin", "b/2/y.bin"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(b"1")
    known = catalog.Catalog.of_root(spark, str(tmp_path))
    known._read = None
    assert known.path("a") == "a/1.10" and known.validate("b", "2") and not known.validate("none")
