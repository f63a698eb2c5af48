"""Importance resampling against a plain model, and its edge cases."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from episodica.llm import resampling
from episodica.llm.resampling import Resampling


def slow_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def slow_ranks(docs, target, how):
    bucket = lambda f: crc32(f.encode()) % how.buckets
    found = [slow_features(text, how.longest) for _, text in docs]
    s = Counter(bucket(f) for _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in slow_features(text, how.longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + how.buckets) / ((s[b] + 1) * (t.total() + how.buckets))))
    rows = []
    for (doc_id, _), (n, fs) in zip(docs, found, strict=True):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= how.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:]))
    drawn = how.percent * len(able) // 100
    ranks = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return sorted(map(str, ranks + [(*r, None) for r in rows if r[1] < how.least_words]))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_ranks_match_model(spark, longest):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "gämma", "x9", "Ω", "zeta-eta", "theta", "ÀB"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
    docs = [(rng.choice([k, k, 3, None]), rng.choice([text(), "", None, "same words " * 12])) for k in range(150)]
    docs += [(None, "of a group of copies without an id " * 4)] * 90 + [(500, "long " * 50_000)]
    target = ["alpha beta gämma"] * 3 + [None, ""]
    how = Resampling(longest=longest, buckets=97, least_words=5, percent=30, seed=7)
    data = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    scores = resampling.scored(data, goal, how)
    got = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in resampling.ranked(scores, how).collect()]
    assert sorted(map(str, got)) == slow_ranks(docs, target, how)


def test_resampled_rows(spark):
    docs = [(k, f"word{k % 5} " * 25, k % 3) for k in range(60)] + [(None, "copy " * 30, 1)] * 40
    data = spark.createDataFrame(docs, "doc_id long, text string, `__row_key` int").withColumns({"score": F.lit(1), "N_words": F.lit(2), "buckets": F.lit("a.b"), "a.b": F.lit(3)})
    goal = spark.createDataFrame([("word1 copy",)], "text string")
    how = Resampling(percent=50)
    drawn = resampling.resampled(data, goal, how)
    assert drawn.columns == data.columns and drawn.count() == 50
    ranks = resampling.ranked(resampling.scored(data, goal, how), how).where("rank is not null")
    want = Counter(r.doc_id for r in ranks.collect())
    assert Counter(r.doc_id for r in drawn.collect()) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    none = docs.limit(0)
    assert [r.weight for r in resampling.scored(docs, none).collect()] == [math.floor(1000 * math.log(1 * (30 + 10_000) / (31 * 10_000)))]
    for corpus, goal in ((none, docs), (none, none)):
        assert resampling.ranked(resampling.scored(corpus, goal)).count() == 0
        assert resampling.resampled(corpus, goal).count() == 0
