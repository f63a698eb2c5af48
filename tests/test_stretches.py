"""Windows of long episodes by stretches against whole ones, and ranges of skewed ids."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators.episodes import ID_RANGES, episode_index, episode_ordinals, to_transitions, with_neighbours, with_range
from episodica.operators.windows import dense_windows, long_windows


def made(spark, lengths):
    rows = [(e, s, n, f"v{e}-{s}" if (e + s) % 5 else None) for e, n in enumerate(lengths) for s in range(n)]
    return spark.createDataFrame(rows, "episode_id long, step int, ep_len int, value string").repartition(3)


@pytest.mark.parametrize("stretch", [1, 2, 7, 1000])
@pytest.mark.parametrize("offsets", [[0], [-3, 0, 2], [-20, -1, 5, 30], [4, 4, -4]])
def test_windows_by_stretches(spark, stretch, offsets):
    lengths = [1, 2, 7, 8, 25]
    got = dense_windows(made(spark, lengths), {"value": offsets}, ("ep_len",), stretch).collect()
    value = lambda e, s: f"v{e}-{s}" if (e + s) % 5 else None
    assert len(got) == sum(lengths)
    assert all(r.value == [value(r.episode_id, max(0, min(r.ep_len - 1, r.step + k))) for k in offsets] for r in got)
    long = long_windows(made(spark, lengths), {"a": ("value", offsets), "b": ("value", [-k for k in offsets])}, (), stretch).collect()
    assert len(long) == sum(lengths) * len(offsets)
    assert all(r.b == value(r.episode_id, max(0, min(lengths[r.episode_id] - 1, r.step - offsets[r.t]))) for r in long)


@pytest.mark.parametrize("stretch", [1, 3, 100])
def test_transitions_by_stretches(spark, stretch):
    steps = made(spark, [1, 3, 9])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(to_transitions(steps, ["value"], stretch=stretch)) == key(to_transitions(steps, ["value"]))


def test_one_long_episode(spark):
    """An episode of a million steps lies in as many groups as it has stretches, each with its neighbours' border rows."""
    n, stretch = 1_000_000, 1 << 16
    steps = spark.range(n).select(F.lit(1).cast("long").alias("episode_id"), F.col("id").cast("int").alias("step"), F.lit(n).alias("ep_len"), F.col("id").alias("value"))
    groups = with_neighbours(steps, 5, 2, stretch).groupBy("__stretch").count().collect()
    assert len(groups) == -(-n // stretch) and max(r["count"] for r in groups) <= stretch + 7
    wrong = dense_windows(steps, {"value": [-5, 0, 2]}, (), stretch).where(
        (F.get("value", F.lit(0)) != F.greatest(F.lit(0), F.col("step") - 5)) | (F.get("value", F.lit(1)) != F.col("step")) | (F.get("value", F.lit(2)) != F.least(F.lit(n - 1), F.col("step") + 2))
    )
    assert wrong.count() == 0


def test_ranges_of_skewed_ids(spark):
    """A hundred thousand dense ids and one far away: no range holds over twice the mean."""
    n = 100_000
    ids = spark.range(n).select(F.col("id").alias("episode_id")).union(spark.createDataFrame([(9 * 10**18,), (-(9 * 10**18),)], "episode_id long"))
    sizes = [r["count"] for r in with_range(ids).groupBy("__range").count().collect()]
    assert sum(sizes) == n + 2 and len(sizes) > ID_RANGES / 2 and max(sizes) <= 2 * n / ID_RANGES
    ends = with_range(ids).groupBy("__range").agg(F.min("episode_id").alias("low"), F.max("episode_id").alias("high")).orderBy("__range").collect()
    assert all(a.high < b.low for a, b in zip(ends, ends[1:], strict=False))


def test_index_of_random_ids(spark):
    rng = random.Random(1)
    lengths = {rng.randrange(-(10 ** rng.randrange(1, 18)), 10 ** rng.randrange(1, 18)): rng.randrange(1, 4) for _ in range(500)}
    steps = spark.createDataFrame([(e, s) for e, n in lengths.items() for s in range(n)], "episode_id long, step int")
    start, want = 0, {}
    for e in sorted(lengths):
        want[e] = start
        start += lengths[e]
    assert {r.episode_id: r.ep_start for r in episode_index(steps).collect()} == want
    assert {r.episode_id: r.ordinal for r in episode_ordinals(steps).collect()} == {e: k for k, e in enumerate(sorted(lengths))}
    assert episode_index(steps.limit(0)).count() == 0
