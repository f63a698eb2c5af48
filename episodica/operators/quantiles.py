"""Exact percentiles per key by narrowing: no task holds a key's values, and values are not exchanged.

A percentile is one or two order statistics. Each of them is looked for in an interval of values that is known to hold
it, at first all values of the key. A pass makes a sketch of each interval, partially in every task, and takes two of
its quantiles around the wanted place; then it counts what is below, at, between and above them, exactly. The part that
holds the place is the next interval, some hundredth of the last one whatever the distribution, and the counts are
right even where the sketch is not. A part of one value is an answer, and parts of at most ``FEW`` values are sorted.

Intervals are broadcast to the values, as Spark takes them for large as the values they come from and would exchange
those by key. Only more than ``BROADCAST`` intervals are exchanged, and values with them, dealt out by ``SALTS``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Quantiles of a sketch, and its accuracy.
GRID = 256
ACCURACY = 4096
FEW = 10_000
#: Intervals that are broadcast; parts in which a key's values are dealt out where there are more.
BROADCAST = 200_000
SALTS = 64


def _wanted(sizes: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """``keys, place, low, high, below, n``: order statistics that the percentiles need, with their first intervals."""
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    places = F.array_distinct(F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)]))
    return sizes.select(*keys, F.explode(places).alias("place"), "low", "high", F.lit(0).cast("bigint").alias("below"), "n")


def _inside(values: DataFrame, wanted: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``values`` by the intervals of ``wanted``, at most ``n`` of them, that hold them."""
    if n <= BROADCAST:
        met = values.join(F.broadcast(wanted), keys)
    else:
        salted = values.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        met = salted.join(wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")
    return met.where(F.col("value").between(F.col("low"), F.col("high")))


def _refined(values: DataFrame, wanted: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``wanted``, ``n`` rows, with smaller intervals."""
    interval = [*keys, "low", "high"]
    grid = F.expr(f"array({', '.join(f'{k / GRID!r}D' for k in range(GRID + 1))})")
    cuts = F.percentile_approx("value", grid, ACCURACY).alias("cuts")
    sketched = wanted.join(_inside(values, wanted.select(*interval).distinct(), keys, n).groupBy(*interval).agg(cuts), interval)
    at = F.floor((F.col("place") - F.col("below")) / F.col("n") * GRID).cast("int")
    cut = lambda k: F.get("cuts", F.greatest(F.lit(0), F.least(F.lit(GRID), k)))
    aimed = sketched.select(*interval, "place", "below", cut(at - 1).alias("a"), cut(at + 2).alias("b"))
    v = F.col("value")
    part = F.when(v < F.col("a"), 0).when(v == F.col("a"), 1).when(v < F.col("b"), 2).when(v == F.col("b"), 3).otherwise(4)
    parts = _inside(values, aimed, keys, n).groupBy(*keys, "place", "below", part.alias("part")).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    order = W.partitionBy(*keys, "place").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # at most five rows
    counted = parts.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    holds = (F.col("below") <= F.col("place")) & (F.col("place") < F.col("below") + F.col("n"))
    return counted.where(holds).select(*keys, "place", "low", "high", "below", "n")


def _sorted(values: DataFrame, wanted: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``keys, place, found`` from ``n`` intervals of at most ``FEW`` values."""
    listed = _inside(values, wanted, keys, n).groupBy(*keys, "place", "below").agg(F.array_sort(F.collect_list("value")).alias("vs"))
    return listed.select(*keys, "place", F.get("vs", (F.col("place") - F.col("below")).cast("int")).alias("found"))


def exact_percentiles(values: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each share from 0 to 1, interpolated linearly between neighbours.

    Nulls and NaN are no values; a key without values is left out, and null keys too. ``values`` is read once for each
    pass, in general five times; it should be a stored table or be persisted. The keys' intervals, at most two rows
    for each share, are passed on through the driver's plan, not its memory.
    """
    known = values.select(*keys, value.cast("double").alias("value")).where("value is not null and not isnan(value)")
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    sizes = known.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).persist()
    open_, answers, kept = _wanted(sizes, keys, list(shares.values())).persist(), [], [sizes]
    while True:
        kept.append(open_)
        one, few = F.col("low") == F.col("high"), F.col("n") <= FEW
        answers.append(open_.where(one).select(*keys, "place", F.col("low").alias("found")))
        n_few, n_rest = open_.agg(F.count_if(~one & few), F.count_if(~one & ~few)).first()
        if n_few:
            answers.append(_sorted(known, open_.where(~one & few), keys, n_few))
        if not n_rest:
            break
        open_ = _refined(known, open_.where(~one & ~few), keys, n_rest).persist()
    found = reduce(DataFrame.unionByName, answers)
    by_key = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "found"))).alias("at"))

    def between(share: float) -> Column:
        at = F.lit(float(share)) * (F.col("n") - 1)
        low, high = (F.element_at("at", f(at).cast("bigint")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at)))

    out = sizes.select(*keys, "n").join(by_key, keys).select(*keys, *[between(p).alias(name) for name, p in shares.items()]).persist()
    out.count()
    for df in kept:
        df.unpersist()
    return out
