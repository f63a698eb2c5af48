"""Evenly spaced clips over an episode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TubeletGrid:
    """``clips`` clips of ``frames`` frames, ``spacing`` seconds apart."""

    clips: int
    frames: int
    spacing: float = 0.1
    control_frequency: float = 10.0

    @property
    def stride(self) -> int:
        """Steps between frames, 1 at least."""
        return max(1, round(self.spacing * self.control_frequency))


def tubelet_steps(episodes: DataFrame, grid: TubeletGrid) -> DataFrame:
    """``episode_id, clip, t, step`` of every frame, for episodes ``(episode_id, ep_len)``.

    Anchors are spread evenly, halves rounded to even, from the first step to the last that a clip
    fits behind; one clip alone is the last. Frames beyond the end repeat the last step.
    """
    last = F.greatest(F.lit(0), F.col("ep_len") - 1 - (grid.frames - 1) * grid.stride)
    clip = F.explode(F.sequence(F.lit(0), F.lit(grid.clips - 1)))
    spread = F.bround(F.col("clip") * last / (grid.clips - 1), 0).cast("int") if grid.clips > 1 else last.cast("int")
    anchors = episodes.select("episode_id", "ep_len", clip.alias("clip")).withColumn("anchor", spread)
    frames = anchors.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(grid.frames - 1))))
    return frames.select(
        "episode_id", "clip", "t", F.least(F.col("ep_len") - 1, F.col("anchor") + F.col("t") * grid.stride).cast("int").alias("step")
    )


def tubelets(steps: DataFrame, episodes: DataFrame, grid: TubeletGrid) -> DataFrame:
    """All leaves at every frame of the grid: a shuffle join on episode and step."""
    return tubelet_steps(episodes, grid).join(steps.drop("ep_len"), ["episode_id", "step"])
