"""Transitions from a stream of steps that come without numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from episodica.sources.store import EpisodeStore


def streamed_transitions(stream: DataFrame, order: list[str], observation: list[str], last: str = "is_last") -> DataFrame:
    """``episode_id, step, observation, done, next``: steps numbered as they come, each with the one behind it.

    The state of an episode is how many steps it has had, and its last step: that one is held until its successor comes,
    in whatever micro-batch, or is let go with its own observation as the next one where ``last`` says that it ends the
    episode. Steps come in order from one micro-batch to the next; inside a micro-batch they are ordered by ``order``.
    A step behind the end begins no new episode and is left out. State is kept by Spark with the query's checkpoint, so
    a query that is stopped goes on where it was. An episode's rows of one micro-batch are one task's; how many there
    are is bounded by the stream's ``maxFilesPerTrigger`` or the like, not by the episode's length.
    """
    fields = {f.name: f for f in stream.schema}
    values = [StructField(f"v{k}", fields[c].dataType, True) for k, c in enumerate(observation)]
    state_schema = StructType([StructField("n", IntegerType()), StructField("ended", BooleanType()), *values])
    out_schema = StructType(
        [StructField("episode_id", fields["episode_id"].dataType), StructField("step", IntegerType()), StructField("done", BooleanType()), *values]
        + [StructField(f"w{k}", fields[c].dataType, True) for k, c in enumerate(observation)]
    )
    names = [f.name for f in out_schema]

    def plain(value: object) -> object:
        return None if value is None or (isinstance(value, float) and value != value) or value is pd.NaT else value

    def step_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ended, *held = state.get if state.exists else (0, False, *[None] * len(observation))
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for row in rows[[*observation, last]].astype(object).itertuples(index=False, name=None):
            if ended:
                break
            now = [plain(v) for v in row[:-1]]
            if n:
                out.append((key[0], n - 1, False, *held, *now))
            held, n = now, n + 1
            if plain(row[-1]) is True:
                ended = True
                out.append((key[0], n - 1, True, *held, *held))
        state.update((n, ended, *held))
        yield pd.DataFrame(out, columns=names, dtype=object)

    read = stream.select("episode_id", *dict.fromkeys([*order, *observation]), F.col(last).cast("boolean").alias(last))
    made = read.groupBy("episode_id").applyInPandasWithState(step_on, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)
    own, then = (F.struct(*[F.col(f"{x}{k}").alias(c) for k, c in enumerate(observation)]) for x in "vw")
    return made.select("episode_id", "step", own.alias("observation"), "done", F.struct(then.alias("observation"), "done").alias("next"))


def ingest_transitions(stream: DataFrame, store: EpisodeStore, checkpoint: str, order: list[str], observation: list[str], last: str = "is_last"):
    """Store the transitions of an unnumbered stream; what a repeated micro-batch brings again is not stored twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            store.append(batch, f"stream-{number}")
        finally:
            batch.unpersist()

    made = streamed_transitions(stream, order, observation, last)
    return made.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
