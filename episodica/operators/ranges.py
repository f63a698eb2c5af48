"""Points in ranges: the first of the ranges that hold a point, in work that is linear in points and in ranges.

A range is cut into at most two blocks of every power of two, as in a segment tree; a point lies in one block of each.
So points and ranges meet by equality of key, power and block. Of all ranges that share a block only the first can be an
answer, and it is found by an aggregation with partial results per task, so that no pair of a point and a range that is
not the first of its block is ever made, and a key with a third of all rows is dealt out by its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two of the blocks of 64-bit ranges.
POWERS = 63


def _down(x: Column, power: Column) -> Column:
    return F.call_function("shiftright", x, power)


def blocks_of(low: Column, high: Column) -> Column:
    """Blocks ``(power, block)`` whose union is ``[low, high)``, none where that is empty or an end is null."""
    low, high = low.cast("bigint"), high.cast("bigint")

    def at(power: Column) -> Column:
        power = power.cast("int")
        first, last = -_down(-low, power), _down(high, power)
        block = lambda b, needed: F.when(needed & (first < last), F.struct(power.alias("power"), b.alias("block")))
        return F.array(block(first, F.pmod(first, F.lit(2)) == 1), block(last - 1, F.pmod(last, F.lit(2)) == 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(POWERS - 1)), at)))


def first_in_range(points: DataFrame, ranges: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``points`` with ``found``, the ``value`` of the first range by ``position`` that holds them, null if none does.

    ``points`` has the columns ``keys`` and ``at``, each combination once; ``ranges`` has ``keys``, ``low``, ``high``
    (excluded), ``position`` and ``value``. Keys that are null meet nothing.
    """
    cut = ranges.select(*keys, "position", "value", F.explode(blocks_of(F.col("low"), F.col("high"))).alias("b"))
    firsts = cut.groupBy(*keys, F.col("b.power").alias("power"), F.col("b.block").alias("block")).agg(F.min(F.struct("position", "value")).alias("best"))
    used = firsts.agg(F.array_sort(F.collect_set("power")).alias("powers"))  # one row of at most POWERS numbers
    spread = points.select(*keys, at).crossJoin(F.broadcast(used)).withColumn("power", F.explode("powers")).drop("powers")
    met = spread.withColumn("block", _down(F.col(at).cast("bigint"), F.col("power"))).join(firsts, [*keys, "power", "block"])
    best = met.groupBy(*keys, at).agg(F.min("best").alias("best"))
    return points.join(best, [*keys, at], "left").withColumn("found", F.col("best.value")).drop("best")
