"""The user's handle on a dataset of episodes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.tensors import channels_first
from episodica.operators import schema
from episodica.operators.episodes import episode_index, explode_episodes, flat_index_of, to_transitions
from episodica.operators.sampling import draw_batches, draw_from, pick_episode
from episodica.operators.selection import filter_tasks, kept_episode_map, select_episodes
from episodica.operators.tubelets import TubeletGrid, tubelets
from episodica.operators.windows import TemporalWindow, batch_windows, default_window
from episodica.sources.records import nested_episodes, numbered_records
from episodica.sources.store import EpisodeStore
from episodica.sources.tabular import tabular_steps
from episodica.sources.tasks import DEFAULT_FPS
from episodica.sources.video import video_steps

#: Draws of up to so many rows are resolved before a store's files are opened.
DRAWN_ROWS = 10_000
CACHE_VARIABLE = "EPISODICA_CACHE"


def cache_root(override: str | None = None) -> str:
    """Where stores are kept: the argument, the environment's, or a folder of the user."""
    return override or os.environ.get(CACHE_VARIABLE) or os.path.expanduser("~/.cache/episodica")


def store_path(name: str, version: str, root: str | None = None) -> str:
    """Where the store of a dataset's version is kept."""
    return "/".join(p for p in (cache_root(root).rstrip("/"), name.strip("/"), version.strip("/")) if p)


def open_store(spark: SparkSession, name: str, version: str, root: str | None = None) -> EpisodeStore:
    """The store of a dataset's version, under the cache's root or another."""
    return EpisodeStore(spark, store_path(name, version, root))


@dataclass(frozen=True)
class TrajectoryDataset:
    """Steps of episodes with a sampler; immutable, every change gives a new handle."""

    steps: DataFrame
    control_frequency: float = 10.0
    sampler: TemporalWindow | TubeletGrid | None = None
    given_index: DataFrame | None = None
    store: EpisodeStore | None = None

    @classmethod
    def from_nested(cls, episodes: DataFrame, observation: list[str] | str = "observation", keep_text: bool = True, **options) -> TrajectoryDataset:
        """From nested episodes ``(episode_id, steps array<struct>)``; bytes of text columns that are UTF-8 become text."""
        return cls(to_transitions(schema.decoded(explode_episodes(episodes)), observation, keep_text), **options)

    @classmethod
    def from_records(cls, spark: SparkSession, path: str, schema: str, observation: list[str] | str = "observation", **options) -> TrajectoryDataset:
        """From shards of records whose payloads are nested episodes as JSON; an episode's id is its place in all shards."""
        return cls.from_nested(nested_episodes(numbered_records(spark, path), schema), observation, **options)

    @classmethod
    def from_tabular(cls, rows: DataFrame, tasks: list | None = None, episodes: list[int] | None = None, **options) -> TrajectoryDataset:
        """From one row per frame; of the given tasks, and of the given episodes within them. Bytes of text columns that are UTF-8 become text."""
        made = cls(tabular_steps(schema.decoded(rows if tasks is None else filter_tasks(rows, tasks))), **options)
        return made if episodes is None else made.select(episodes)

    @classmethod
    def from_video(
        cls, tasks: DataFrame, cameras: dict[str, DataFrame], chosen: list[int] | None = None, map_path: str | None = None, **options
    ) -> TrajectoryDataset:
        """From tasks ``(task_id, episode_id, task_name)`` and frames by camera; of the chosen tasks.

        With ``map_path``, global ids are those of the map kept there, to which new tasks are added.
        """
        wanted = tasks if chosen is None else tasks.where(F.col("task_id").isin(chosen))
        known = None if map_path is None else kept_episode_map(wanted, map_path)
        return cls(to_transitions(video_steps(wanted, cameras, known), list(cameras)), **{"control_frequency": DEFAULT_FPS} | options)

    @classmethod
    def from_store(cls, store: EpisodeStore, episodes: DataFrame | None = None, split: str | None = None, **options) -> TrajectoryDataset:
        """From a store as it is now, whose manifest is the episode index; samples open only files that hold their draws.

        Of all episodes, of those given, or of those of a split that the store keeps.
        """
        if split is not None:
            episodes = store.split(split) if episodes is None else select_episodes(store.split(split), episodes)
        fixed = store.at(store.snapshot().version) if store.version is None and store.versions() else store
        return cls(fixed.read(episodes).drop("flat_index"), given_index=fixed.index(episodes), store=fixed, **options)

    @cached_property
    def index(self) -> DataFrame:
        """``episode_id, ep_start, ep_len``, made once and kept for all samples of this handle."""
        return (episode_index(self.steps) if self.given_index is None else self.given_index).persist()

    def select(self, episodes: list[int]) -> TrajectoryDataset:
        """The given episodes; a ``ValueError`` names those that there are not."""
        spark = self.steps.sparkSession
        wanted = spark.createDataFrame([(int(e),) for e in sorted(set(episodes))], "episode_id bigint")
        lost = wanted.join(self.steps.select("episode_id").distinct(), "episode_id", "left_anti").limit(20).collect()
        if lost or not episodes:
            raise ValueError(f"no such episodes: {sorted(r.episode_id for r in lost)}")
        return replace(self, steps=select_episodes(self.steps, wanted), given_index=None, store=None)

    @cached_property
    def _sizes(self) -> tuple[int, int]:
        found = self.index.agg(F.count("*").alias("n"), F.coalesce(F.sum("ep_len"), F.lit(0)).alias("total")).first()
        return found.n, found.total

    def num_episodes(self) -> int:
        """Number of episodes."""
        return self._sizes[0]

    def num_steps(self) -> int:
        """Number of steps."""
        return self._sizes[1]

    def info(self) -> dict:
        """Episodes, steps, frequency, and kind, type and shape of every leaf; of a store, its description and splits too."""
        leaves = {m.path: {"kind": m.kind, "dtype": m.dtype, "shape": list(m.shape)} for m in self.get_modalities()}
        told = {} if self.store is None else {k: v for k, v in self.store.info().items() if k != "members"}
        return {"episodes": self.num_episodes(), "steps": self.num_steps(), "control_frequency": self.control_frequency, "leaves": leaves, **told}

    def splits(self, shares: dict[str, float], seed: int | str = 0) -> dict[str, TrajectoryDataset]:
        """Datasets of disjoint episodes, each episode dealt to a split by a hash of its id."""
        at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("episode_id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
        out, low = {}, 0.0
        for name, share in shares.items():
            out[name] = replace(self, steps=self.steps.where((at >= low) & (at < low + share)), given_index=None, store=None)
            low += share
        return out

    def row(self, flat_index: int) -> DataFrame:
        """One step by its flat index: its episode is found in the index."""
        inside = (F.col("ep_start") <= flat_index) & (F.col("ep_start") + F.col("ep_len") > flat_index)
        return flat_index_of(self.steps, self.index.where(inside)).where(F.col("flat_index") == flat_index)

    def get_modalities(self) -> list[schema.ModalitySpec]:
        """Specs of all leaves."""
        return schema.specs(self.steps)

    def modalities(self) -> dict[str, list[str]]:
        """Paths of leaves by kind."""
        return schema.grouped(self.get_modalities())

    def image_keys(self) -> list[str]:
        """Paths of image leaves."""
        return self.modalities().get("image", [])

    def with_sampler(self, sampler: TemporalWindow | TubeletGrid) -> TrajectoryDataset:
        """The same steps under another sampler."""
        return replace(self, sampler=sampler)

    def with_windows(self, delta_timestamps: dict[str, list[float]]) -> TrajectoryDataset:
        """Windows for some leaves, the anchor alone for the others."""
        return self.with_sampler(default_window(schema.window_leaves(self.steps), delta_timestamps, self.control_frequency))

    def preprocess(self, transform: Callable[[DataFrame], DataFrame]) -> TrajectoryDataset:
        """The steps under a transform of DataFrames."""
        return replace(self, steps=self.steps.transform(transform), given_index=None, store=None)

    def config(self) -> dict:
        """What ``with_config`` needs to sample alike in another session."""
        sampler = None if self.sampler is None else {"kind": type(self.sampler).__name__, **asdict(self.sampler)}
        return {"control_frequency": self.control_frequency, "sampler": sampler}

    def with_config(self, config: dict) -> TrajectoryDataset:
        """The same steps under a sampler and frequency that ``config`` gave."""
        given = dict(config["sampler"] or {})
        kinds = {k.__name__: k for k in (TemporalWindow, TubeletGrid)}
        sampler = kinds[given.pop("kind")](**given) if given else None
        return replace(self, control_frequency=config["control_frequency"], sampler=sampler)

    def image_shapes(self) -> dict[str, tuple[int, ...]]:
        """Paths of image leaves whose fields name a height, width and number of channels."""
        return {m.path: m.shape for m in self.get_modalities() if m.kind == "image" and len(m.shape) == 3}

    def sample(self, batch_size: int = 32, seed: int | str = 0) -> DataFrame:
        """A batch of windows around drawn anchors, or the tubelets of a drawn episode; images channels first."""
        if not self.num_steps():
            raise ValueError("the dataset has no steps")
        if isinstance(self.sampler, TubeletGrid):
            return self._tubelets(pick_episode(self.index, seed))
        return self._gathered(draw_from(self.index, batch_size, seed), batch_size)

    def epoch(self, batch_size: int, seeds: range) -> DataFrame:
        """The batches of consecutive seeds in one plan: one draw, one gather, rows with their ``seed``.

        Each batch equals that of ``sample`` under its seed.
        """
        if not self.num_steps():
            raise ValueError("the dataset has no steps")
        if isinstance(self.sampler, TubeletGrid):
            raise ValueError("tubelets come of one episode at a time")
        drawn = draw_batches(self.index, batch_size, seeds)
        number = F.col("seed").cast("bigint") * batch_size + F.col("b")
        batch = self._gathered(drawn.withColumn("b", number).drop("seed"), batch_size * len(seeds))
        return batch.select(F.floor(F.col("b") / batch_size).alias("seed"), *[(F.pmod("b", F.lit(batch_size)).alias("b") if c == "b" else F.col(f"`{c}`")) for c in batch.columns])

    def _reach(self, draws: DataFrame, window: TemporalWindow, rows: int) -> tuple[DataFrame, DataFrame]:
        """Steps to gather from, and the draws: of a store, few draws are resolved first and only their files opened."""
        if self.store is None or rows > DRAWN_ROWS:
            return self.steps, draws
        drawn = draws.collect()  # at most DRAWN_ROWS rows
        offsets = [0, *(k for leaf in window.delta_timestamps for k in (*window.offsets(leaf), *window.next_offsets(leaf)))]
        inside = lambda r, k: max(0, min(r.ep_len - 1, r.anchor_step + k))
        places = [(r.episode_id, inside(r, min(offsets)), inside(r, max(offsets))) for r in drawn]
        known = self.steps.sparkSession.createDataFrame(drawn, draws.schema)
        return self.store.steps_at(places).select(*[F.col(f"`{c}`") for c in self.steps.columns]), known

    def _gathered(self, draws: DataFrame, rows: int) -> DataFrame:
        window = self.sampler or default_window(schema.window_leaves(self.steps), {}, self.control_frequency)
        own = ("episode_id", "step", "ep_len")
        leaves = [p for p, _ in schema.leaf_fields(self.steps.schema) if p not in own]
        for leaf in window.delta_timestamps:
            schema.require_leaf(self.steps, leaf)
        steps, anchors = self._reach(draws, window, rows)
        flat = steps.select(*own, *[schema.leaf_column(p).alias(p) for p in leaves])
        renamed = {p: p.replace("/", "__") for p in leaves}
        plain = flat.withColumnsRenamed(renamed)
        inner = TemporalWindow({renamed[k]: v for k, v in window.delta_timestamps.items()}, window.control_frequency)
        batch = batch_windows(plain, anchors, inner, rows)
        back = {v: k for k, v in renamed.items()} | {f"next/{v}": f"next/{k}" for k, v in renamed.items() if k in window.delta_timestamps}
        windowed = [f"next/{renamed[k]}" for k in window.delta_timestamps]
        clash = {f"next/{k}" for k in window.delta_timestamps}  # a mirrored window replaces the stored leaf
        keep = [c for c in batch.columns if c in windowed or back.get(c, c) not in clash]
        shapes = self.image_shapes()

        def value(column: str) -> Column:
            name = back.get(column, column)
            leaf = name.removeprefix("next/") if column in windowed else name
            found, in_window = F.col(f"`{column}`"), leaf in window.delta_timestamps and (column in windowed or name == leaf)
            return (channels_first(found, shapes[leaf], int(in_window)) if leaf in shapes else found).alias(name)

        return batch.select(*[value(c) for c in keep])

    def _tubelets(self, episode: DataFrame) -> DataFrame:
        clips = tubelets(self.steps, episode, self.sampler)
        for path, shape in self.image_shapes().items():
            root, _, rest = path.partition("/")
            made = channels_first(schema.leaf_column(path), shape)
            clips = clips.withColumn(root, F.col(root).withField(rest.replace("/", "."), made) if rest else made)
        return clips

    def batches(self, batch_size: int = 32, seed: int = 0, planned: int = 64) -> Iterator[DataFrame]:
        """Batches without end, each of its own seed; beginning at a later seed goes on from there.

        ``planned`` batches at a time are drawn and gathered in one plan, and kept until the next ones are.
        """
        if isinstance(self.sampler, TubeletGrid):
            while True:
                yield self.sample(batch_size, seed)
                seed += 1
        while True:
            made = self.epoch(batch_size, range(seed, seed + planned)).persist()
            try:
                for k in range(seed, seed + planned):
                    yield made.where(F.col("seed") == k).drop("seed")
            finally:
                made.unpersist()
            seed += planned
