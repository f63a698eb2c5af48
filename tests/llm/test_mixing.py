"""Mixing against a brute-force water filling, and its edge cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from episodica.llm import mixing


def slow_targets(sizes):
    """Share by weight, cap, share the excess again, until no source is above its cap."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, budget, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        capped = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not capped:
            return target | {s: level * weight[s] for s in left}
        target |= {s: 2.0 * sizes[s] for s in capped}
        budget -= sum(2 * sizes[s] for s in capped)
        left -= capped
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_words_taken(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "b", "é", "z", None, "B"]), " ".join(["w"] * int(rng.paretovariate(0.8)))) for k in range(300)]
    rows += [(k, "tiny", "one") for k in range(400, 402)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).repartition(3)
    served = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    want, taken = slow_targets(sizes), defaultdict(int)
    for r in served:
        s = None if r.source_null else r.source_key
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
        taken[s] += r.words_taken
        assert 0 <= r.words_taken <= r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    mix = sorted((r for r in served if r.words_taken), key=lambda r: r.mix_start)
    at = 0
    for r in mix:
        assert r.mix_start == at
        at += r.words_taken
    whole = [r.virtual_finish for r in mix if r.virtual_finish <= 1]
    assert whole == sorted(whole)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, served)) == sorted(map(str, again))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "a", ""), (None, "a", "x y"), (None, "a", "x y")], "doc_id long, source string, text string")
    assert sum(r.words_taken for r in mixing.mix(docs).collect()) == 6
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix(docs.where("size(split(text, 'q')) < 0 or text = ''")).where("words_taken > 0").collect() == []
    names = ("size", "target", "copies", "servings", "words_taken", "epoch", "u", "source_key")
    wide = docs.withColumns({c: F.lit("clash") for c in names})
    out = mixing.mixed_documents(wide)
    assert out.columns == wide.columns and [r.text for r in out.collect()].count("x y") == 3


def test_first_words(spark):
    text = "  one\ttwo \n three\x0bfour  "
    df = spark.createDataFrame([(text,)], "t string")
    got = [df.select(mixing.first_words(F.col("t"), F.lit(n))).first()[0] for n in (1, 2, 3, 4)]
    assert got == ["  one", "  one\ttwo", "  one\ttwo \n three", "  one\ttwo \n three\x0bfour"]
