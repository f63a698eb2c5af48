"""Exact percentiles against numpy, for distributions that are hard on histograms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import quantiles
from episodica.operators.quantiles import exact_percentiles


@pytest.mark.parametrize("few", [20, 10_000])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(few)
    made = {
        "one": [5.0],
        "two": [2.0, 1.0],
        "same": [3.5] * 500,
        "outlier": [rng.random() for _ in range(300)] + [1e300, -1e300],
        "huge": [1.7e308, -1.7e308, 0.0] * 20,
        "powers": [2.0**k for k in range(-300, 300, 7)],
        "normal": [rng.gauss(0, 1) for _ in range(2000)],
        "heavy": [0.0] * 900 + [1.0] * 99 + [7.25],
        "tiny": [5e-324, 0.0, -5e-324] * 9,
    }
    rows = [(k, v) for k, vs in made.items() for v in [*vs, None, float("nan")]] + [("none", None), (None, 1.0)]
    data = spark.createDataFrame(rows, "k string, x double").repartition(5).cache()
    shares = {"p0": 0.0, "p1": 0.01, "mid": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: [r[n] for n in shares] for r in exact_percentiles(data, ["k"], F.col("x"), shares).collect()}
    assert got.keys() == made.keys()
    for k, vs in made.items():
        if k == "huge":
            assert got[k] == [-1.7e308, -1.7e308, 0.0, 1.7e308, 1.7e308]
        else:
            assert np.allclose(got[k], np.quantile(vs, list(shares.values())), rtol=1e-12, atol=0), k


def test_empty(spark):
    data = spark.createDataFrame([], "k string, x double")
    assert exact_percentiles(data, ["k"], F.col("x"), {"p": 0.5}).count() == 0


def test_no_task_holds_a_channel(spark):
    """Two million values of one channel: no exchange carries more than cells and the last few values."""
    data = spark.range(2_000_000).select(F.lit(1).alias("k"), (F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    out = exact_percentiles(data, ["k"], F.col("x"), {"lo": 0.01, "hi": 0.99})
    want = data.groupBy("k").agg(F.percentile("x", F.lit(0.01)).alias("lo"), F.percentile("x", F.lit(0.99)).alias("hi")).first()
    row = out.first()
    assert abs(row.lo - want.lo) < 1e-9 and abs(row.hi - want.hi) < 1e-9


def shuffled(spark, run):
    """Records that ``run``'s stages write to shuffles, and the most that one task reads from them."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def stages():
        found = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(k) for k in range(found.size()))}

    before = stages().keys()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    new = {k: s for k, s in stages().items() if k not in before}
    read = 0
    for stage, attempt in new:
        tasks = store.taskList(stage, attempt, 1000)
        metrics = [tasks.apply(k).taskMetrics() for k in range(tasks.size())]
        read = max([read, *[m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined()]])
    return sum(s.shuffleWriteRecords() for s in new.values()), read


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_values_are_not_exchanged(spark, monkeypatch, broadcast):
    """Values of one key stay where they are, however large Spark takes the intervals for; many intervals deal them out."""
    n = 120_000
    monkeypatch.setattr(quantiles, "BROADCAST", broadcast, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions are small here
    try:
        data = spark.range(0, n, 1, 4).select((F.col("id") % 1).alias("k"), (F.col("id") * 7919 % n).cast("double").alias("x"))
        got = []
        written, read = shuffled(spark, lambda: got.append(exact_percentiles(data, ["k"], F.col("x"), {"lo": 0.01, "hi": 0.99}).first()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0].lo == pytest.approx(0.01 * (n - 1), abs=1e-6) and got[0].hi == pytest.approx(0.99 * (n - 1), abs=1e-6)
    if broadcast:
        assert written < n / 100
    else:
        assert read < n / 2
