"""Queries that write and read back: the episode store, streaming ingestion, sampled batches, videos."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.dataset import TrajectoryDataset
from episodica.functions.names import strip_slashes
from episodica.operators.episodes import last_run_index, number_steps, to_transitions
from episodica.plans.steps import EVENTS_SQL, TURNS_SQL, event_steps, turn_steps
from episodica.sources.store import EpisodeStore
from episodica.sources.tables import table
from episodica.sources.video import video_steps
from episodica.streaming.ingest import ingest


def fresh(spark: SparkSession, stem: str) -> str:
    """A path in the folder that driver and executors share; a local one only for a session on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="episodica-")
    return f"{root.rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def store_incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a conversation are stored first, then all: the second build adds the missing ones only."""
    steps = event_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "event_id", "value")
    store = EpisodeStore(spark, fresh(spark, "store"))
    everyone = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"))
    talking = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"))
    store.build(steps, talking, "talking")
    store.build(steps, everyone, "rest")
    batches = store.manifest().select("episode_id", "batch", "n_steps")
    return store.read().join(batches, "episode_id").select("episode_id", "step", "event_id", "flat_index", "batch", "n_steps")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations arrive as a stream of files and are stored whole."""
    steps = turn_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "role", "text")
    source, state = fresh(spark, "stream-in"), fresh(spark, "stream-state")
    steps.repartition(4, "episode_id").write.parquet(source)
    store = EpisodeStore(spark, fresh(spark, "stream-store"))
    ingest(spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 2).parquet(source), store, state).awaitTermination()
    return store.read().select("episode_id", "step", "role", "flat_index")


def dataset_sample_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of the dataset handle: windowed value, its mirrored window, other leaves at the anchor."""
    steps = to_transitions(event_steps(spark, sf_dir), ["value"], extras=["event_type"])
    batch = TrajectoryDataset(steps).with_windows({"observation/value": [-0.2, 0.0]}).sample(64, seed=7)
    at = lambda name, k: F.get(F.col(f"`{name}`"), F.lit(k))
    return batch.select(
        "b",
        "episode_id",
        "anchor_step",
        at("observation/value", 0).alias("v0"),
        at("observation/value", 1).alias("v1"),
        at("next/observation/value", 0).alias("n0"),
        at("next/observation/value", 1).alias("n1"),
        "event_type",
        "done",
    )


def video_episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks by nation, their orders by priority as two cameras of unequal length."""
    tasks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("task_id"), F.col("c_custkey").alias("episode_id"), F.col("c_mktsegment").alias("task_name"))
    orders = table(spark, sf_dir, "orders").withColumn("value", F.col("o_totalprice"))
    cameras = {
        name: number_steps(orders.where(F.col("o_orderpriority").startswith(k)), "o_custkey", ["o_orderkey"]).select("episode_id", "step", "value")
        for name, k in (("head", "1"), ("hand", "5"))
    }
    return video_steps(tasks, cameras).select("episode_id", "step", "ep_len", "head", "hand", "language_instruction")


def episode_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as stored by part: an order that recurs is known by its last run."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), (F.floor(F.col("o_orderkey") / 7) % 50).alias("e"))
    return last_run_index(rows, "e", "position")


def stripped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without their scheme and without slashes at their ends."""
    return table(spark, sf_dir, "pages").select("page_id", strip_slashes(F.regexp_replace("url", "^[a-z]+:", "")).alias("name"))


QUERIES = {f.__name__: f for f in (store_incremental_build, stream_ingest, dataset_sample_batch, video_episode_steps, episode_last_run, stripped_names)}
ORACLE_SQL = {
    "store_incremental_build": f"""WITH {EVENTS_SQL} SELECT episode_id, step, event_id, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat_index,
  CASE WHEN episode_id IN (SELECT conv_id FROM conversations) THEN 'talking' ELSE 'rest' END AS batch, ep_len::BIGINT AS n_steps FROM ev""",
    "stream_ingest": f"WITH {TURNS_SQL} SELECT episode_id, step, role, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat_index FROM tn",
    "dataset_sample_batch": f"""WITH {EVENTS_SQL}, fl AS (SELECT *, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat FROM ev), an AS (
  SELECT b, fl.* FROM (SELECT b, cast(concat('0x', substr(md5(concat('7:', b::VARCHAR)), 1, 15)) AS BIGINT) % (SELECT count(*) FROM ev) AS flat
    FROM (SELECT unnest(range(64)) AS b)) JOIN fl USING (flat))
SELECT b, an.episode_id, an.step AS anchor_step, x.value AS v0, an.value AS v1, an.value AS n0, y.value AS n1, an.event_type, an.step = an.ep_len - 1 AS done
FROM an JOIN ev x ON x.episode_id = an.episode_id AND x.step = greatest(0, an.step - 2)
JOIN ev y ON y.episode_id = an.episode_id AND y.step = least(an.ep_len - 1, an.step + 2)""",
    "video_episode_steps": """WITH g AS (SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS gid, c_custkey, c_mktsegment FROM customer),
o AS (SELECT o_custkey, o_orderpriority[1:1] AS k, o_totalprice AS v, (row_number() OVER (PARTITION BY o_custkey, o_orderpriority[1:1] ORDER BY o_orderkey) - 1)::INT AS step FROM orders),
j AS (SELECT a.o_custkey, a.step, a.v AS head, b.v AS hand FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.step = b.step AND a.k = '1' AND b.k = '5')
SELECT gid AS episode_id, step, (count(*) OVER (PARTITION BY gid))::INT AS ep_len, head, hand, c_mktsegment AS language_instruction FROM j JOIN g ON c_custkey = o_custkey""",
    "episode_last_run": """WITH r AS (SELECT o_orderkey AS p, o_orderkey // 7 % 50 AS e FROM orders),
n AS (SELECT *, sum((e IS DISTINCT FROM l)::INT) OVER (ORDER BY p) AS run FROM (SELECT *, lag(e) OVER (ORDER BY p) AS l FROM r)),
b AS (SELECT e, run, min(p) AS ep_start, count(*) AS ep_len FROM n GROUP BY e, run)
SELECT e AS episode_id, arg_max(ep_start, run) AS ep_start, arg_max(ep_len, run) AS ep_len FROM b GROUP BY e""",
    "stripped_names": "SELECT page_id, trim(regexp_replace(url, '^[a-z]+:', ''), '/') AS name FROM pages",
}
