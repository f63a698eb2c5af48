"""Episodes of videos: tasks, the global map, archives and cameras put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.operators.selection import align_cameras, archives_of, find_archives, global_episode_map, require_archives, task_of_archive
from episodica.sources.archives import aligned_frames, camera_members, member_frames, members
from episodica.sources.tasks import DEFAULT_CAMERAS


def video_steps(tasks: DataFrame, cameras: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    """Steps of episodes by global id: a frame of every camera, the task as language, no action.

    An episode is as long as its shortest camera. ``cameras`` maps a name to ``episode_id, step,
    value``; ``known`` is a global map to go on using.
    """
    numbered = (known if known is not None else global_episode_map(tasks)).join(tasks.select("task_id", "episode_id", "task_name"), ["task_id", "episode_id"])
    frames = align_cameras(cameras)
    lengths = frames.groupBy("episode_id").agg(F.count("*").cast("int").alias("ep_len"))
    observed = frames.withColumnsRenamed({f"value_{c}": c for c in cameras}).join(lengths, "episode_id")
    return _as_steps(numbered.join(observed, "episode_id"), tuple(cameras))


def _as_steps(observed: DataFrame, cameras: tuple[str, ...]) -> DataFrame:
    return observed.select(
        F.col("global_id").alias("episode_id"),
        "step",
        "ep_len",
        *cameras,
        F.array(F.lit(0.0).cast("float")).alias("action"),
        F.lit(0.0).cast("float").alias("reward"),
        F.col("task_name").alias("language_instruction"),
    )


def read_videos(tasks: DataFrame, listing: DataFrame, root: str, decode: Callable[[bytes], list[bytes]], cameras: tuple[str, ...] = DEFAULT_CAMERAS) -> DataFrame:
    """Steps of the tasks' episodes from archives under ``root``.

    Only archives that hold an episode are opened, only the episodes' videos read, and each is decoded once. Where
    episodes lie stays persisted for the result's readers, as it is looked up to be checked already.
    """
    found = require_archives(find_archives(tasks.select("task_id", "episode_id").distinct(), archives_of(listing)).persist())
    located = found.select("episode_id", F.concat(F.lit(f"{root.rstrip('/')}/"), "path").alias("path"))
    index = camera_members(members(located), cameras).join(located, ["path", "episode_id"], "left_semi")
    named = camera_members(member_frames(index, decode, strict=True), cameras).withColumn("task_id", task_of_archive("path"))
    observed = aligned_frames(named, ["task_id", "episode_id"], cameras)
    numbered = global_episode_map(tasks).join(tasks.select("task_id", "episode_id", "task_name"), ["task_id", "episode_id"])
    return _as_steps(numbered.join(observed, ["task_id", "episode_id"]), cameras)
