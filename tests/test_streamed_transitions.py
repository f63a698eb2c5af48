"""Unnumbered steps over many micro-batches, with a restart in between, against the batch plan."""

import random

from pyspark.sql import functions as F

from episodica.operators.episodes import number_steps, to_transitions
from episodica.sources.store import EpisodeStore
from episodica.streaming.transitions import ingest_transitions

SCHEMA = "episode_id long, at long, x double, word string, is_last boolean"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    lengths = {e: rng.choice([1, 2, 5, 17]) for e in range(12)} | {99: 40}
    rows, at = [], {e: 0 for e in lengths}
    while any(at[e] < n for e, n in lengths.items()):
        e = rng.choice([e for e, n in lengths.items() if at[e] < n])
        rows.append((e, len(rows), rng.choice([None, 1.5, float(at[e])]), rng.choice([None, "a", "b"]), True if at[e] == lengths[e] - 1 else rng.choice([None, False])))
        at[e] += 1
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    store = EpisodeStore(spark, str(tmp_path / "store"))
    size = 25

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_transitions(stream, store, state, ["at"], ["x", "word"]).awaitTermination()

    def give(part):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    for k, part in enumerate(parts):
        give(part)
        if k in (1, len(parts) - 1):
            run()  # a new query each time, which goes on from the first one's state
    give([(0, 10**6, 7.0, "late", None)])  # behind the end of its episode
    run()
    batch = to_transitions(number_steps(spark.createDataFrame(rows, SCHEMA), "episode_id", ["at"]), ["x", "word"])
    columns = ["episode_id", "step", "observation.x", "observation.word", "done", F.col("next.observation.x").alias("nx"), F.col("next.observation.word").alias("nw"), F.col("next.done").alias("nd")]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(store.stored()) == key(batch)
