"""Incremental ingestion of steps into an episode store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from episodica.sources.store import EpisodeStore


def ingest(stream: DataFrame, store: EpisodeStore, checkpoint: str) -> StreamingQuery:
    """Store the numbered steps that each micro-batch brings, each step once.

    An episode may come in several micro-batches, and steps may come again: what is stored is not
    stored twice. A micro-batch that is repeated after a failure adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            store.append(batch, f"stream-{number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
