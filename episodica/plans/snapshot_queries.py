"""Queries on stores that grow by parts, and on batches that are drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.dataset import TrajectoryDataset
from episodica.plans.steps import EVENTS_SQL, event_steps
from episodica.plans.store_queries import fresh
from episodica.sources.store import EpisodeStore
from episodica.sources.tables import table

COLUMNS = ["episode_id", "step", "ep_len", "event_id", "value"]
BATCH, SEEDS, PARTS = 32, range(3, 11), 9


def store_completed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single events of every user come first, then a build brings the others: episodes are whole, each step once."""
    steps = event_steps(spark, sf_dir).select(*COLUMNS)
    store = EpisodeStore(spark, fresh(spark, "store"))
    store.append(steps.where("step % 3 = 1"), "some")
    everyone = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"))
    lacking = store.missing(everyone).withColumn("lacked", F.lit(True))
    lacking = lacking.persist()  # as it is before the build
    lacking.count()
    store.build(steps.union(steps), everyone, "rest")
    told = store.manifest().join(lacking, "episode_id", "left").select("episode_id", "batch", "n_steps", F.coalesce("lacked", F.lit(False)).alias("lacked"))
    return store.read().join(told, "episode_id").select("episode_id", "step", "event_id", "flat_index", "batch", "n_steps", "lacked")


def store_later_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users come in parts, the later ones with a further column and with columns named like the store's own, merged and compacted."""
    steps = event_steps(spark, sf_dir).select(*COLUMNS)
    store = EpisodeStore(spark, fresh(spark, "store"), fan_in=3)
    for k in range(PARTS):
        part = steps.where(F.col("episode_id") % PARTS == k)
        store.append(part if k < PARTS // 2 else part.withColumns({"bucket": F.col("event_id") % 5, "part": F.lit(f"p{k}"), "file": F.col("value") * 2}), str(k))
    store.compact()
    return store.read().select("episode_id", "step", "event_id", "flat_index", F.coalesce("bucket", F.lit(-1)).alias("bucket"), "part", "file")


def store_sample_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch drawn from a store of several parts, of which only the files of drawn steps are opened."""
    steps = event_steps(spark, sf_dir).select(*COLUMNS)
    store = EpisodeStore(spark, fresh(spark, "store"))
    for k in range(4):
        store.append(steps.where(F.col("episode_id") % 4 == k), str(k))
    batch = TrajectoryDataset.from_store(store).with_windows({"value": [-0.2, 0.0, 0.1]}).sample(BATCH, SEEDS.start)
    return _spread(batch).select("b", "episode_id", "anchor_step", "event_id", "w0", "w1", "w2", "n0", "n1", "n2")


def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of consecutive seeds, drawn and gathered in one plan."""
    data = TrajectoryDataset(event_steps(spark, sf_dir).select(*COLUMNS)).with_windows({"value": [-0.2, 0.0, 0.1]})
    return _spread(data.epoch(BATCH, SEEDS)).select("seed", "b", "episode_id", "anchor_step", "event_id", "w0", "w1", "w2", "n0", "n1", "n2")


def _spread(batch: DataFrame) -> DataFrame:
    columns = {f"{short}{k}": F.get(F.col(f"`{name}`"), F.lit(k)) for short, name in (("w", "value"), ("n", "next/value")) for k in range(3)}
    return batch.withColumns(columns | {"event_id": F.get("event_id", F.lit(0))})


_DRAWN = f"""an AS (
  SELECT seed, b, fl.* FROM (
    SELECT seed, b, cast(concat('0x', substr(md5(concat(seed::VARCHAR, ':', b::VARCHAR)), 1, 15)) AS BIGINT) % (SELECT count(*) FROM ev) AS flat
    FROM (SELECT unnest(range({SEEDS.start}, {SEEDS.stop})) AS seed), (SELECT unnest(range({BATCH})) AS b)
  ) JOIN (SELECT *, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat FROM ev) fl USING (flat)
), around AS (
  SELECT seed, b, an.episode_id, an.step AS anchor_step, an.event_id, o, e.value
  FROM an, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) JOIN ev e ON e.episode_id = an.episode_id AND e.step = greatest(0, least(an.ep_len - 1, an.step + o))
)"""
_PICK = ", ".join(f"max(value) FILTER (o = {o}) AS {name}" for name, o in (("w0", -2), ("w1", 0), ("w2", 1), ("n0", -1), ("n1", 0), ("n2", 2)))
QUERIES = {f.__name__: f for f in (store_completed_parts, store_later_columns, store_sample_batch, epoch_batches)}
ORACLE_SQL = {
    "store_completed_parts": f"""WITH {EVENTS_SQL} SELECT episode_id, step, event_id, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat_index,
  CASE WHEN ep_len > 1 THEN 'some' ELSE 'rest' END AS batch, ep_len::BIGINT AS n_steps, true AS lacked FROM ev""",
    "store_later_columns": f"""WITH {EVENTS_SQL} SELECT episode_id, step, event_id, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat_index,
  CASE WHEN late THEN event_id % 5 ELSE -1 END AS bucket, CASE WHEN late THEN 'p' || (episode_id % {PARTS}) END AS part, CASE WHEN late THEN value * 2 END AS file
FROM (SELECT *, episode_id % {PARTS} >= {PARTS // 2} AS late FROM ev)""",
    "store_sample_batch": f"WITH {EVENTS_SQL}, {_DRAWN} SELECT b, episode_id, anchor_step, event_id, {_PICK} FROM around WHERE seed = {SEEDS.start} GROUP BY b, episode_id, anchor_step, event_id",
    "epoch_batches": f"WITH {EVENTS_SQL}, {_DRAWN} SELECT seed, b, episode_id, anchor_step, event_id, {_PICK} FROM around GROUP BY seed, b, episode_id, anchor_step, event_id",
}
