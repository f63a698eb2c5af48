"""Points in ranges against the plain product, and its cost."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators.ranges import blocks_of, first_in_range
from episodica.operators.selection import find_archives, skill_at


def test_blocks_cover_their_range(spark):
    rng = random.Random(1)
    ends = [(0, 0), (0, 1), (5, 3), (None, 4), (1, None), (0, 2**40), (-(2**62), 2**62)] + [tuple(sorted(rng.randrange(-300, 300) for _ in (0, 1))) for _ in range(200)]
    rows = spark.createDataFrame(ends, "low long, high long").select("low", "high", blocks_of(F.col("low"), F.col("high")).alias("b")).collect()
    for r in rows:
        parts = sorted((x.block << x.power, (x.block + 1) << x.power) for x in r.b)
        if r.low is None or r.high is None or r.low >= r.high:
            assert not parts
            continue
        assert parts[0][0] == r.low and parts[-1][1] == r.high and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (r.high - r.low).bit_length()


@pytest.mark.parametrize("span", [40, 10**6])
def test_first_in_range(spark, span):
    rng = random.Random(span)
    key = lambda: rng.choice([1, 1, 1, 2, None])
    points = sorted({(key(), rng.randrange(-span, span)) for _ in range(300)} - {(None, None)}, key=str)
    ranges = []
    for k in range(200):
        low = rng.randrange(-span, span)
        ranges.append((key(), low, low + rng.randrange(-5, span // 2), rng.randrange(9), f"v{k:03d}"))
    want = {}
    for k, p in points:
        held = [(pos, v) for rk, low, high, pos, v in ranges if k is not None and rk == k and low <= p < high]
        want[k, p] = min(held)[1] if held else None
    got = first_in_range(spark.createDataFrame(points, "k int, p long"), spark.createDataFrame(ranges, "k int, low long, high long, position int, value string"), ["k"], "p")
    assert {(r.k, r.p): r.found for r in got.collect()} == want


def test_empty_sides(spark):
    points = spark.createDataFrame([(1, 2)], "k int, p long")
    ranges = spark.createDataFrame([(1, 0, 9, 0, "a")], "k int, low long, high long, position int, value string")
    assert [r.found for r in first_in_range(points, ranges.limit(0), ["k"], "p").collect()] == [None]
    assert first_in_range(points.limit(0), ranges, ["k"], "p").count() == 0


def test_one_task_of_many_archives(spark):
    """100,000 episodes and 100,000 archives of one task, all archives overlapping: no product is made."""
    n = 100_000
    episodes = spark.range(n).select(F.lit(7).cast("long").alias("task_id"), F.col("id").alias("episode_id"))
    archives = spark.range(n).select(F.lit(7).cast("long").alias("task_id"), F.col("id").alias("first"), (F.col("id") + n).alias("last"), (-F.col("id")).alias("position"), F.concat(F.lit("a"), "id").alias("path"))
    found = find_archives(episodes, archives)
    assert found.where(F.col("path") == F.concat(F.lit("a"), "episode_id")).count() == n


def test_skills_of_one_long_episode(spark):
    n = 50_000
    frames = spark.range(n).select(F.lit(1).cast("long").alias("episode_id"), F.col("id").cast("int").alias("step"))
    segments = spark.range(n // 5).select(F.lit(1).cast("long").alias("episode_id"), F.col("id").alias("position"), (F.col("id") * 5).alias("start_frame"), F.lit(n).alias("end_frame"), F.concat(F.lit("s"), "id").alias("action_text"))
    got = skill_at(frames, segments)
    assert got.where("skill = 's0'").count() == n
