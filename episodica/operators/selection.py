"""Choosing episodes and tasks, and joining them with archives, skills and cameras."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from episodica.operators.ranges import first_in_range

#: Columns that may hold the episode and the task, in order of preference.
EPISODE_COLUMNS = ("episode_index", "episode_id", "traj_id", "trajectory_id")
TASK_COLUMNS = ("task_index", "task_id", "task")


def episode_column(columns: list[str]) -> str:
    """The column that holds the episode id."""
    found = next((c for c in EPISODE_COLUMNS if c in columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(EPISODE_COLUMNS)} is in {', '.join(columns)}")
    return found


def task_column(columns: list[str]) -> str | None:
    """The column that holds the task, if there is one."""
    return next((c for c in TASK_COLUMNS if c in columns), None)


def select_episodes(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Steps of the wanted episodes, each once however often it is wanted."""
    return steps.join(wanted.select("episode_id").distinct(), "episode_id", "left_semi")


def filter_tasks(rows: DataFrame, tasks: list) -> DataFrame:
    """Rows of the given tasks."""
    column = task_column(rows.columns)
    if column is None:
        raise ValueError(f"no task column in {', '.join(rows.columns)}")
    return rows.where(F.col(column).isin(list(tasks)))


def missing_episodes(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted episodes that are not present."""
    return wanted.select("episode_id").distinct().join(present, "episode_id", "left_anti")


def _key_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the digest of all ids, comma-joined in the order in which they come."""
    digest, n = hashlib.md5(), 0
    for batch in batches:
        ids = batch.column(0).cast(pa.string()).to_pylist()
        if ids:
            digest.update((("," if n else "") + ",".join(ids)).encode())
            n += len(ids)
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()[:16]]), pa.array([n])], names=["selection_key", "n_episodes"])


def selection_key(selected: DataFrame) -> DataFrame:
    """``selection_key, n_episodes``: 16 hex digits that name a set of episodes, whatever its order.

    A digest is made in order, so one task reads the distinct ids; they are streamed to it from a
    sort that spills, a batch at a time, and no list of them is ever built.
    """
    ids = selected.select(F.col("episode_id").cast("bigint").alias("episode_id")).where("episode_id is not null").distinct()
    made = ids.repartition(1).sortWithinPartitions("episode_id").mapInArrow(_key_of_sorted, "selection_key string, n_episodes bigint")
    empty = F.substring(F.md5(F.lit("")), 1, 16)
    return made.agg(F.coalesce(F.max_by("selection_key", "n_episodes"), empty).alias("selection_key"), F.coalesce(F.max("n_episodes"), F.lit(0)).alias("n_episodes"))


def global_episode_map(episodes: DataFrame) -> DataFrame:
    """Dense ``global_id`` from 0 over ``(task_id, episode_id)``, tasks one after another.

    Only tasks are numbered in one task; episodes are numbered within theirs.
    """
    known = episodes.select("task_id", "episode_id").distinct()
    sizes = known.groupBy("task_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("task_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("task_id", before.alias("start"))
    own = F.row_number().over(W.partitionBy("task_id").orderBy("episode_id")) - 1
    return known.join(starts, "task_id").select((F.col("start") + own).cast("bigint").alias("global_id"), "task_id", "episode_id")


def extend_episode_map(known: DataFrame, episodes: DataFrame) -> DataFrame:
    """The map with episodes of new tasks appended; tasks it knows stay as they are."""
    fresh = global_episode_map(episodes.join(known.select("task_id").distinct(), "task_id", "left_anti"))
    top = known.agg(F.coalesce(F.max("global_id"), F.lit(-1)).alias("top"))
    return known.unionByName(fresh.crossJoin(F.broadcast(top)).select((F.col("global_id") + F.col("top") + 1).alias("global_id"), "task_id", "episode_id"))


def save_episode_map(known: DataFrame, path: str) -> None:
    """Keep a map for later sessions."""
    known.write.mode("overwrite").parquet(path)


def load_episode_map(spark: SparkSession, path: str) -> DataFrame:
    """A map that was kept."""
    return spark.read.schema("global_id bigint, task_id bigint, episode_id bigint").parquet(path)


def kept_episode_map(episodes: DataFrame, path: str) -> DataFrame:
    """The map kept at ``path``, with episodes of tasks that it lacks added to it, there as well.

    Every change is a version of its own, ``v=0`` first, so a map that is being read is never written.
    """
    spark = episodes.sparkSession
    try:
        versions = spark.read.schema("global_id bigint, task_id bigint, episode_id bigint, v int").parquet(path)
        last = versions.agg(F.max("v")).first()[0]
        known = versions.where(F.col("v") == last).drop("v")
    except AnalysisException:
        last, known = -1, spark.createDataFrame([], "global_id bigint, task_id bigint, episode_id bigint")
    if episodes.select("task_id").distinct().join(known, "task_id", "left_anti").isEmpty():
        return known
    save_episode_map(extend_episode_map(known, episodes), f"{path}/v={last + 1}")
    return load_episode_map(spark, f"{path}/v={last + 1}")


def _part_of_archive(path: str, k: int) -> Column:
    return F.regexp_extract(path, r"(?:^|/)(\d+)/(\d+)-(\d+)\.tar$", k)


def task_of_archive(path: str) -> Column:
    """The task that the column ``path`` of an archive names."""
    return _part_of_archive(path, 1).cast("bigint")


def archives_of(paths: DataFrame) -> DataFrame:
    """``task_id, first, last, position, path`` of archives named ``.../{task}/{first}-{last}.tar``."""
    part = lambda k: _part_of_archive("path", k)
    return paths.where(part(1) != "").select(
        task_of_archive("path").alias("task_id"), part(2).cast("bigint").alias("first"), part(3).cast("bigint").alias("last"), "position", "path"
    )


def find_archives(episodes: DataFrame, archives: DataFrame) -> DataFrame:
    """The first listed archive of the task whose range, ends included, holds the episode; null if none."""
    ranges = archives.select("task_id", F.col("first").alias("low"), (F.col("last") + 1).alias("high"), "position", F.col("path").alias("value"))
    found = first_in_range(episodes.select("task_id", "episode_id").distinct(), ranges, ["task_id"], "episode_id")
    return found.withColumnRenamed("found", "path")


def require_archives(found: DataFrame) -> DataFrame:
    """``found``, or an error that counts the episodes without an archive."""
    lost = found.where("path is null").count()
    if lost:
        raise ValueError(f"no archive holds {lost} of the episodes")
    return found


def skill_at(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """``frames`` with the text of the first segment that holds them, its end excluded; '' if none."""
    start, end = (F.coalesce(c, F.lit(0)) for c in ("start_frame", "end_frame"))
    ranges = segments.select("episode_id", start.alias("low"), end.alias("high"), "position", F.col("action_text").alias("value"))
    found = first_in_range(frames.select("episode_id", "step").distinct(), ranges, ["episode_id"], "step")
    return found.select("episode_id", "step", F.coalesce("found", F.lit("")).alias("skill"))


def skill_in(step: Column, segments: Column) -> Column:
    """The same for segments in an array column of the row."""
    inside = F.filter(segments, lambda s: (step >= F.coalesce(s["start_frame"], F.lit(0))) & (step < F.coalesce(s["end_frame"], F.lit(0))))
    return F.coalesce(F.get(inside, F.lit(0))["action_text"], F.lit(""))


def align_cameras(cameras: dict[str, DataFrame]) -> DataFrame:
    """Frames that every camera has: ``episode_id, step`` and a column ``value_<camera>`` each."""
    named = [df.select("episode_id", "step", F.col("value").alias(f"value_{name}")) for name, df in cameras.items()]
    return reduce(lambda a, b: a.join(b, ["episode_id", "step"]), named)
