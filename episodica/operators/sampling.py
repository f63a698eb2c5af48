"""Reproducible draws of anchors and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.functions.names import seeded_draw
from episodica.operators.episodes import episode_index


#: Draws of up to so many rows are broadcast to the index; more are shuffled.
BROADCAST_DRAWS = 100_000


def draw_from(index: DataFrame, batch_size: int, seed: int | str) -> DataFrame:
    """``b, episode_id, anchor_step, ep_len``: steps drawn uniformly with replacement from an episode index.

    A draw is a flat index by hash of seed and number. Flat indices are cut into buckets of the mean
    episode's length; a draw meets the few episodes that reach into its bucket in an equi-join, to
    which the draws are broadcast while they are few.
    """
    numbers = index.sparkSession.range(batch_size).select(F.col("id").alias("b"), F.lit(str(seed)).alias("seed"))
    return _placed(index, numbers, batch_size).drop("seed")


def draw_batches(index: DataFrame, batch_size: int, seeds: range) -> DataFrame:
    """The draws of ``draw_from`` for consecutive seeds at once, with their ``seed``."""
    every = index.sparkSession.range(batch_size * len(seeds))
    numbers = every.select((F.col("id") % batch_size).alias("b"), (seeds.start + F.floor(F.col("id") / batch_size)).cast("string").alias("seed"))
    return _placed(index, numbers, batch_size * len(seeds))


def _placed(index: DataFrame, numbers: DataFrame, rows: int) -> DataFrame:
    size = index.agg(F.sum("ep_len").cast("bigint").alias("total"), F.ceil(F.avg("ep_len")).alias("__width"))  # one row
    draws = numbers.crossJoin(F.broadcast(size))
    flat = draws.withColumn("flat", seeded_draw(F.col("seed"), F.col("b"), F.col("total"))).select("b", "seed", "flat", F.floor(F.col("flat") / F.col("__width")).alias("__bucket"))
    first, last = (F.floor(x / F.col("__width")) for x in (F.col("ep_start"), F.col("ep_start") + F.col("ep_len") - 1))
    reach = index.crossJoin(F.broadcast(size)).withColumn("__bucket", F.explode(F.sequence(first, last)))
    inside = (F.col("flat") >= F.col("ep_start")) & (F.col("flat") < F.col("ep_start") + F.col("ep_len"))
    found = reach.join(F.broadcast(flat) if rows <= BROADCAST_DRAWS else flat, "__bucket").where(inside)
    return found.select("b", "seed", "episode_id", (F.col("flat") - F.col("ep_start")).cast("int").alias("anchor_step"), "ep_len")


def draw_anchors(steps: DataFrame, batch_size: int, seed: int | str) -> DataFrame:
    """The same from steps, whose episodes are indexed first."""
    return draw_from(episode_index(steps), batch_size, seed)


def draw_episode(steps: DataFrame, seed: int | str) -> DataFrame:
    """``episode_id, ep_len`` of one episode drawn uniformly over episodes: the least of their hashes."""
    return pick_episode(steps.groupBy("episode_id").agg(F.count("*").alias("ep_len")), seed)


def pick_episode(lengths: DataFrame, seed: int | str) -> DataFrame:
    """The same from the episodes' lengths, such as an episode index."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("episode_id").cast("string")))
    return lengths.select("episode_id", F.col("ep_len").cast("int").alias("ep_len")).orderBy(digest, "episode_id").limit(1)
