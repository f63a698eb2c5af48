"""Task files and archives of video datasets."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_SCHEMA = (
    "episode_id bigint, task_name string,"
    " label_info struct<action_config: array<struct<start_frame: bigint, end_frame: bigint, action_text: string, skill: string>>>"
)

#: Cameras that are read by default.
DEFAULT_CAMERAS = ("head_color", "hand_left_color", "hand_right_color")
DEFAULT_FPS = 30.0


def task_ids(paths: DataFrame) -> DataFrame:
    """Task ids of files named ``task_info/task_{id}.json``, in order."""
    found = F.regexp_extract("path", r"(?:^|/)task_info/task_(.+)\.json$", 1)
    return paths.select(found.try_cast("bigint").alias("task_id")).where("task_id is not null").distinct().orderBy("task_id")


def read_tasks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``task_id, episode_id, task_name, action_config`` of task files."""
    rows = spark.read.schema(TASK_SCHEMA).json(paths, multiLine=True)
    task = F.regexp_extract(F.input_file_name(), r"task_(\d+)\.json$", 1).cast("bigint")
    return rows.select(task.alias("task_id"), "episode_id", "task_name", F.col("label_info.action_config").alias("action_config"))


def decode_frames(archives: DataFrame, decode: Callable[[bytes], list[bytes]], cameras: tuple[str, ...] = DEFAULT_CAMERAS, strict: bool = False) -> DataFrame:
    """``episode_id, camera, step, value``: frames of the cameras' videos in archives ``(path, content)``.

    Members are named ``{episode}/videos/{camera}.mp4``. ``decode`` turns a video into raw frames; a
    video that it fails on or that has none is an error if ``strict``, else it has no rows.
    """

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        parts = member.name.strip("/").split("/")
                        camera = parts[-1].rpartition(".")[0]
                        if camera not in cameras or not parts[0].isdigit():
                            continue
                        try:
                            found = decode(archive.extractfile(member).read())
                        except (ValueError, OSError, EOFError) as error:
                            if strict:
                                raise ValueError(f"{member.name} can't be decoded") from error
                            continue
                        if strict and not len(found):
                            raise ValueError(f"{member.name} has no frames")
                        yield pd.DataFrame({"episode_id": int(parts[0]), "camera": camera, "step": range(len(found)), "value": found})

    return archives.mapInPandas(frames, "episode_id bigint, camera string, step int, value binary")


def imageio_decoder(content: bytes) -> list[bytes]:
    """Raw RGB frames by imageio, where it is installed."""
    try:
        import imageio.v3 as iio
    except ImportError as error:
        raise RuntimeError("decoding videos needs imageio, or a decoder of your own") from error
    return [frame.tobytes() for frame in iio.imiter(content, extension=".mp4")]
