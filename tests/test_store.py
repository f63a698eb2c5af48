"""The episode store: whole episodes, any columns, snapshots, merges, and samples that open what they draw."""

import os
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from episodica.dataset import TrajectoryDataset, cache_root, open_store
from episodica.sources.store import EpisodeStore


def made(spark, lengths, **columns):
    rows = [(e, s, n, float(10 * e + s)) for e, n in enumerate(lengths) for s in range(n)]
    return spark.createDataFrame(rows, "episode_id long, step int, ep_len int, value double").withColumns({k: F.lit(v) for k, v in columns.items()})


def test_build_after_a_part(spark, tmp_path):
    """An episode of which a stream brought one step is not whole, and a build brings the others."""
    steps, store = made(spark, [3, 2]), EpisodeStore(spark, str(tmp_path))
    everyone = steps.select("episode_id").distinct()
    store.append(steps.where("step = 1"), "0")
    assert {r.episode_id for r in store.missing(everyone).collect()} == {0, 1} and not store.is_stored(everyone)
    store.build(steps, everyone, "1")
    assert store.is_stored(everyone) and sorted((r.episode_id, r.step) for r in store.read().collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert {(r.episode_id, r.n_steps, r.expected, r.batch) for r in store.manifest().collect()} == {(0, 3, 3, "0"), (1, 2, 2, "0")}
    assert len(store.versions()) == 2
    store.build(steps.union(steps), everyone, "2")
    assert len(store.versions()) == 2


def test_without_lengths(spark, tmp_path):
    """Steps without ``ep_len`` are offered again by a build, and repeated rows are stored once."""
    steps, store = made(spark, [3, 2]).drop("ep_len"), EpisodeStore(spark, str(tmp_path))
    store.append(steps.where("step = 0"), "0")
    store.build(steps.union(steps), steps, "1")
    assert store.read().count() == 5


def test_any_columns(spark, tmp_path):
    """Columns of whatever name stay; later ones are null before; another type is refused."""
    names = {"bucket": 7, "part": "p", "file": 1, "batch": "b", "n_steps": 5, "began": 2, "a b.c": 3}
    store = EpisodeStore(spark, str(tmp_path))
    store.append(made(spark, [2], **names), "0")
    more = made(spark, [0, 2], later=9)
    store.append(more, "1")
    rows = {(r.episode_id, r.step): r.asDict() for r in store.read().collect()}
    assert len(rows) == 4
    assert all(rows[0, 1][k] == v for k, v in names.items()) and rows[0, 1]["later"] is None
    assert rows[1, 0]["later"] == 9 and rows[1, 0]["bucket"] is None
    with pytest.raises(ValueError, match="column later"):
        store.append(made(spark, [0, 0, 2], later="text"), "2")
    assert store.read().count() == 4


def test_snapshots_merges_and_vacuum(spark, tmp_path):
    """Forty writes leave a few parts; old versions can be read until they are vacuumed; leavings go."""
    store = EpisodeStore(spark, str(tmp_path), fan_in=4)
    steps = made(spark, [2] * 40).cache()
    for k in range(40):
        store.append(steps.where(F.col("episode_id") == k), f"b{k:02d}")
    parts = store.snapshot().parts
    assert len(parts) <= 4 * 3 and max(p.level for p in parts) >= 2
    assert {r.episode_id: r.batch for r in store.manifest().collect()} == {k: f"b{k:02d}" for k in range(40)}
    assert sorted(r.flat_index for r in store.read().collect()) == list(range(80))
    before = store.at(store.versions()[3])
    n = before.read().count()
    assert n < 80 and before.read().count() == n
    (tmp_path / "data" / "0000000099-broken").mkdir()
    store.compact()
    assert len(store.snapshot().parts) == 1 and store.read().count() == 80
    assert store.vacuum() == 0 and before.read().count() == n  # all of it is young
    assert store.vacuum(keep=1, least_age=0.0) > 20 and len(store.versions()) == 1
    assert [p.name for p in (tmp_path / "data").iterdir()] == [store.snapshot().parts[0].name] and store.read().count() == 80
    with pytest.raises(ValueError, match="no version"):
        before.read()


def test_two_writers(spark, tmp_path):
    """Of two writes that begin at one version, the second fails and adds nothing."""

    class Slow(EpisodeStore):
        def _commit(self, after):
            EpisodeStore(spark, self.root).append(made(spark, [1]), "other")
            super()._commit(after)

    with pytest.raises(RuntimeError, match="another write"):
        Slow(spark, str(tmp_path)).append(made(spark, [0, 3]), "slow")
    assert [(r.episode_id, r.batch) for r in EpisodeStore(spark, str(tmp_path)).manifest().collect()] == [(0, "other")]


def test_appends_cost_alike(spark, tmp_path):
    """Files that an append of a new episode reads do not grow with the number of writes."""
    store = EpisodeStore(spark, str(tmp_path), fan_in=3)
    for k in range(14):
        store.append(made(spark, [0] * k + [2]), str(k))
    assert len(store.snapshot().parts) <= 3 * 3
    assert store._files(store.snapshot(), made(spark, [0] * 14 + [2])) == []


def opened_bytes(df):
    """Sizes of the files that a plan opens."""
    return sum(os.path.getsize(unquote(urlparse(f).path)) for f in df.inputFiles())


def test_samples_open_what_they_draw(spark, tmp_path):
    """A batch from a store equals that of the steps, and opens only the files of its draws."""
    steps = made(spark, [20] * 200).withColumn("blob", F.concat(*[F.sha2(F.concat_ws(":", "episode_id", "step", F.lit(k)), 512) for k in range(20)]))
    store = EpisodeStore(spark, str(tmp_path), fan_in=100)
    for k in range(20):
        store.append(steps.where(F.col("episode_id") % 20 == k), str(k))
    plain, stored = (d.with_windows({"value": [-0.3, 0.0, 0.1]}) for d in (TrajectoryDataset(steps), TrajectoryDataset.from_store(store)))
    key = lambda df: sorted(map(str, df.select("b", "episode_id", "anchor_step", "value", "`next/value`", "blob").collect()))
    assert key(plain.sample(32, 5)) == key(stored.sample(32, 5))
    whole = len(store.read().inputFiles())
    drawn = stored.sample(2, 3)
    assert whole >= 20 and len(drawn.inputFiles()) <= 2
    files = len(stored.sample(1, 3).inputFiles())
    assert files == 1
    assert len(plain.sample(2, 3).collect()) == 2 == drawn.count()
    assert 0 < opened_bytes(drawn) < opened_bytes(store.read()) / 5


def test_epoch_equals_single_samples(spark):
    """Many batches in one plan are those of their seeds, and an iteration can begin at any of them."""
    data = TrajectoryDataset(made(spark, [5, 1, 9, 3])).with_windows({"value": [-0.1, 0.0]})
    columns = ["b", "episode_id", "anchor_step", "value", "next/value"]
    key = lambda df: sorted(map(str, df.select(*[f"`{c}`" for c in columns]).collect()))
    epoch = data.epoch(6, range(3, 28)).cache()
    assert epoch.count() == 25 * 6
    for seed in (3, 4, 17, 27):
        assert key(epoch.where(F.col("seed") == seed)) == key(data.sample(6, seed))
    some = data.batches(6, seed=16, planned=2)
    assert [key(next(some)) for _ in range(3)] == [key(data.sample(6, k)) for k in (16, 17, 18)]
    some.close()


def test_descriptions_and_splits(spark, tmp_path, monkeypatch):
    """Splits and description are kept with the store; an unknown split, and an episode in two of them, raise."""
    monkeypatch.setenv("EPISODICA_CACHE", str(tmp_path))
    store = open_store(spark, "/robots/", "1.2")
    assert store.root == f"{tmp_path}/robots/1.2" and cache_root("/x") == "/x" and open_store(spark, "a", "", "/r").root == "/r/a"
    store.append(made(spark, [3, 2, 4]), "0")
    assert store.info()["splits"] == {}
    with pytest.raises(ValueError, match="no split train, there are none"):
        TrajectoryDataset.from_store(store, split="train")
    splits = spark.createDataFrame([(0, "train"), (2, "train"), (1, "test")], "episode_id long, split string")
    store.describe("three episodes", splits)
    train = TrajectoryDataset.from_store(store, split="train")
    assert (train.num_episodes(), train.num_steps()) == (2, 7)
    assert train.info()["description"] == "three episodes" and train.info()["splits"] == {"test": 1, "train": 2}
    with pytest.raises(ValueError, match="no split val, there are test, train"):
        store.split("val")
    with pytest.raises(ValueError, match="more than one"):
        store.describe("", splits.union(splits.limit(1)))
    assert store.info()["description"] == "three episodes"


def test_bytes_become_text(spark):
    """Bytes that are UTF-8 are text where a name says so; others are kept as bytes in a column of their own, images as they are."""
    from episodica.operators import schema

    rows = [(0, [(1.0, bytearray("grüße".encode())), (2.0, None)]), (1, [(3.0, bytearray(b"\xff\xfe"))])]
    nested = spark.createDataFrame(rows, "episode_id long, steps array<struct<x:double,instruction:binary>>")
    steps = TrajectoryDataset.from_nested(nested, ["x"]).steps
    assert sorted((r.episode_id, r.step, r.instruction or "") for r in steps.collect()) == [(0, 0, "grüße"), (0, 1, ""), (1, 0, "")]
    flat = spark.createDataFrame([(bytearray(b"ok"), bytearray(b"ok")), (bytearray(b"\xff"), bytearray(b"\xff"))], "caption binary, image binary")
    assert [tuple(r) for r in schema.decoded(flat).select("caption", "caption_bytes", "image").collect()] == [("ok", None, b"ok"), (None, b"\xff", b"\xff")]
    assert schema.decoded(flat, ["image"]).columns == ["caption", "image", "image_bytes"]


@pytest.mark.parametrize("keep_text", [True, False])
def test_observations_of_any_type(spark, keep_text):
    """An observation that is no struct becomes one; the fields of a struct may be named like other columns."""
    rows = [(0, [((1.0, "a"), [0.5]), ((2.0, "b"), [1.5])])]
    nested = spark.createDataFrame(rows, "episode_id long, steps array<struct<observation:struct<action:double,word:string>,action:array<double>>>")
    out = TrajectoryDataset.from_nested(nested, keep_text=keep_text).steps.orderBy("step").collect()
    assert [r.observation.asDict() for r in out] == [{"action": 1.0} | ({"word": "a"} if keep_text else {}), {"action": 2.0} | ({"word": "b"} if keep_text else {})]
    assert out[0].next.observation.action == 2.0 and out[0].action == [0.5]
    plain = spark.createDataFrame([(0, [(7,), (8,)])], "episode_id long, steps array<struct<observation:int>>")
    assert [(r.observation.obs, r.next.observation.obs) for r in TrajectoryDataset.from_nested(plain).steps.orderBy("step").collect()] == [(7, 8), (8, 8)]
