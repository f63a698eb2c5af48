"""Queries that write sources and read them back, and on long or skewed episodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.dataset import TrajectoryDataset, open_store
from episodica.operators.episodes import episode_index, number_steps, to_transitions
from episodica.operators.quantiles import exact_percentiles
from episodica.operators.selection import kept_episode_map, skill_at
from episodica.operators.windows import dense_windows
from episodica.plans.steps import EVENTS_SQL, LINES_SQL, TURNS_SQL, event_steps, line_steps, turn_steps
from episodica.plans.store_queries import fresh
from episodica.sources.archives import write_archives
from episodica.sources.records import nested_episodes, numbered_records, write_records
from episodica.sources.store import EpisodeStore
from episodica.sources.tables import table
from episodica.sources.video import read_videos
from episodica.streaming.transitions import ingest_transitions

STRETCH, FAR = 1024, 9 * 10**18
OFFSETS = [-3, 0, 2]


def record_shard_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as nested episodes in record shards, read back with ids by their place in all shards."""
    step = F.struct("step", "event_id", "value")
    nested = event_steps(spark, sf_dir).groupBy("episode_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    ordered = nested.repartitionByRange(6, "episode_id").sortWithinPartitions("episode_id")
    path = fresh(spark, "shards")
    write_records(ordered.select(F.to_json(F.struct(F.col("episode_id").alias("user_id"), "steps")).cast("binary").alias("payload")), path)
    read = nested_episodes(numbered_records(spark, path), "user_id bigint, steps array<struct<step:int,event_id:bigint,value:double>>")
    return read.select(F.col("episode_id").alias("place"), "user_id", F.explode("steps").alias("s")).select("place", "user_id", "s.step", "s.event_id", "s.value")


def archive_video_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as videos of two cameras in archives by nation, written and read back by ranges of their members."""
    root = fresh(spark, "videos")
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("task_id"), F.col("c_custkey").cast("long").alias("episode_id"), F.col("c_mktsegment").alias("task_name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode_id"), "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    camera = F.when(F.col("p") <= "3", "head").otherwise("hand")
    videos = orders.groupBy("episode_id", camera.alias("camera")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), " ").alias("content"))
    both = videos.groupBy("episode_id").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    tasks = customers.join(both, "episode_id", "left_semi").select("task_id", "episode_id", "task_name")
    block = F.floor(F.col("episode_id") / 100) * 100
    path = F.concat_ws("/", F.lit("observations"), F.col("task_id"), F.concat(block, F.lit("-"), block + 99, F.lit(".tar")))
    files = videos.join(customers, "episode_id").select(path.alias("name"), F.concat(F.col("episode_id"), F.lit("/videos/"), "camera", F.lit(".mp4")).alias("member"), F.col("content").cast("binary").alias("content"))
    listed = fresh(spark, "listing")
    write_archives(files.withColumn("path", F.concat(F.lit(f"{root}/"), "name"))).write.parquet(listed)  # one row for each archive
    name = F.expr(f"substring(path, {len(root) + 2})")
    listing = spark.read.parquet(listed).select(name.alias("position"), name.alias("path"))  # in order of names
    steps = read_videos(tasks, listing, root, bytes.split, ("head", "hand"))
    return steps.select("episode_id", "step", "ep_len", F.col("head").cast("string").alias("head"), F.col("hand").cast("string").alias("hand"), "language_instruction")


def _one_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("all", F.lit(1).cast("long"))
    return number_steps(events, "all", ["ts", "event_id"], F.to_date("ts"))


def long_episode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long episode, windowed by stretches that carry their neighbours' border rows."""
    made = dense_windows(_one_episode(spark, sf_dir), {"value": OFFSETS}, ("event_id",), STRETCH)
    return made.select("step", "event_id", *[F.get("value", F.lit(k)).alias(f"v{k}") for k in range(len(OFFSETS))])


def long_episode_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long episode in the transition layout, by stretches."""
    steps = to_transitions(_one_episode(spark, sf_dir), ["value", "event_id"], extras=[], stretch=STRETCH)
    return steps.select("step", F.col("observation.event_id").alias("event_id"), F.col("next.observation.event_id").alias("next_event"), F.col("next.observation.value").alias("next_value"), "done")


def skewed_episode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events where every seventh user has an id far away: the index of episodes in order of ids."""
    steps = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 7 == 0, F.col("user_id") + FAR).otherwise(F.col("user_id")).alias("episode_id"))
    return episode_index(steps)


def skill_segments_of_one_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a segment of one long episode of all events: each event's first segment in order of keys, by blocks."""
    frames = _one_episode(spark, sf_dir).select("episode_id", "step")
    start = F.col("o_custkey") * 3 % 9001
    segments = table(spark, sf_dir, "orders").select(F.lit(1).cast("long").alias("episode_id"), F.col("o_orderkey").alias("position"), start.alias("start_frame"), (start + F.col("o_orderkey") % 50).alias("end_frame"), F.col("o_orderkey").cast("string").alias("action_text"))
    return skill_at(frames, segments).select("step", "skill")


def exact_event_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last percentiles of events' values by type, by narrowing."""
    found = exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), {"p1": 0.01, "p50": 0.5, "p99": 0.99})
    return found.select("event_type", *[F.round(c, 9).alias(c) for c in ("p1", "p50", "p99")])


def stream_unnumbered_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns stream in without step numbers, stop, and go on: transitions across micro-batches."""
    turns = turn_steps(spark, sf_dir).withColumn("is_last", F.col("step") == F.col("ep_len") - 1).select("episode_id", "turn", "role", "is_last", "step")
    source, state = fresh(spark, "stream-in"), fresh(spark, "stream-state")
    store = EpisodeStore(spark, fresh(spark, "stream-store"))
    schema = turns.drop("step").schema
    for part in (F.col("step") < 3, F.col("step") >= 3):  # the second one's query goes on from the first one's state
        turns.where(part).drop("step").repartition(2, "episode_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
        ingest_transitions(stream, store, state, ["turn"], ["turn", "role"]).awaitTermination()
    return store.read().select("episode_id", "step", "observation.role", F.col("next.observation.role").alias("next_role"), F.col("next.observation.turn").alias("next_turn"), "done")


def stored_split_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that a store keeps, by the market segments of customers: steps and counts of each split's users."""
    steps = event_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "value")
    store = open_store(spark, "events", "1.0", fresh(spark, "cache"))
    store.append(steps, "all")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id")).distinct()
    store.describe("events by user", users.withColumn("split", F.when(F.col("episode_id") % 5 == 0, "val").otherwise("train")))
    parts = []
    for split, n in store.info()["splits"].items():
        data = TrajectoryDataset.from_store(store, split=split)
        parts.append(data.steps.select(F.lit(split).alias("split"), F.lit(n).cast("long").alias("n_episodes"), "episode_id", "step", "value"))
    return reduce(DataFrame.unionByName, parts)


def wrapped_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested orders whose steps have one number as their observation: it becomes a field, now and next."""
    lines = line_steps(spark, sf_dir).select("episode_id", F.struct("step", F.col("l_quantity").cast("double").alias("observation")).alias("s"))
    nested = lines.groupBy("episode_id").agg(F.array_sort(F.collect_list("s")).alias("steps")).withColumn("steps", F.transform("steps", lambda s: F.struct(s["observation"].alias("observation"))))
    made = TrajectoryDataset.from_nested(nested).steps
    return made.select("episode_id", "step", F.col("observation.obs").alias("obs"), F.col("next.observation.obs").alias("next_obs"))


def kept_map_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global map that is kept: customers of even nations first, then all, whose new tasks come behind."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("task_id"), F.col("c_custkey").cast("long").alias("episode_id"))
    path = fresh(spark, "map")
    kept_episode_map(rows.where("task_id % 2 = 0"), path)
    return kept_episode_map(rows, path)


QUERIES = {f.__name__: f for f in (record_shard_steps, archive_video_steps, long_episode_windows, long_episode_transitions, skewed_episode_index, skill_segments_of_one_episode, exact_event_percentiles, stream_unnumbered_transitions, stored_split_steps, wrapped_observations, kept_map_episodes)}
_ALL = "al AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1)::INT AS step, count(*) OVER () AS n FROM events)"
ORACLE_SQL = {
    "stored_split_steps": f"""WITH {EVENTS_SQL}, s AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, * FROM ev)
SELECT split, (SELECT count(DISTINCT user_id) FROM s t WHERE t.split = s.split) AS n_episodes, episode_id, step, value FROM s""",
    "wrapped_observations": f"""WITH {LINES_SQL} SELECT a.episode_id, a.step, a.l_quantity::DOUBLE AS obs, b.l_quantity::DOUBLE AS next_obs
FROM ln a JOIN ln b ON a.episode_id = b.episode_id AND b.step = least(a.ep_len - 1, a.step + 1)""",
    "kept_map_episodes": "SELECT row_number() OVER (ORDER BY c_nationkey % 2, c_nationkey, c_custkey) - 1 AS global_id, c_nationkey::BIGINT AS task_id, c_custkey::BIGINT AS episode_id FROM customer",
    "stream_unnumbered_transitions": f"""WITH {TURNS_SQL} SELECT a.episode_id, a.step, a.role, b.role AS next_role, b.turn AS next_turn, a.step = a.ep_len - 1 AS done
FROM tn a JOIN tn b ON a.episode_id = b.episode_id AND b.step = least(a.ep_len - 1, a.step + 1)""",
    "record_shard_steps": f"WITH {EVENTS_SQL} SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS place, user_id, step, event_id, value FROM ev",
    "archive_video_steps": """WITH o AS (
  SELECT o_custkey, o_orderpriority[1:1] <= '3' AS is_head, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey, o_orderpriority[1:1] <= '3' ORDER BY o_orderkey) - 1 AS step FROM orders
), j AS (SELECT a.o_custkey, a.step, a.o_orderkey AS head, b.o_orderkey AS hand FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.step = b.step AND a.is_head AND NOT b.is_head
), g AS (SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS gid, c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM j))
SELECT gid AS episode_id, step::INT AS step, (count(*) OVER (PARTITION BY gid))::INT AS ep_len, head::VARCHAR AS head, hand::VARCHAR AS hand, c_mktsegment AS language_instruction FROM j JOIN g ON c_custkey = o_custkey""",
    "long_episode_windows": f"WITH {_ALL} SELECT a.step, a.event_id, x.value AS v0, a.value AS v1, y.value AS v2 FROM al a JOIN al x ON x.step = greatest(0, a.step - 3) JOIN al y ON y.step = least(a.n - 1, a.step + 2)",
    "long_episode_transitions": f"WITH {_ALL} SELECT a.step, a.event_id, y.event_id AS next_event, y.value AS next_value, a.step = a.n - 1 AS done FROM al a JOIN al y ON y.step = least(a.n - 1, a.step + 1)",
    "skewed_episode_index": f"""SELECT e AS episode_id, (sum(n) OVER (ORDER BY e) - n)::BIGINT AS ep_start, n AS ep_len
FROM (SELECT CASE WHEN user_id % 7 = 0 THEN user_id + {FAR} ELSE user_id END AS e, count(*) AS n FROM events GROUP BY e)""",
    "skill_segments_of_one_episode": f"""WITH {_ALL}, s AS (SELECT o_orderkey AS p, o_custkey * 3 % 9001 AS a, o_custkey * 3 % 9001 + o_orderkey % 50 AS z FROM orders)
SELECT step, coalesce(min(p)::VARCHAR, '') AS skill FROM al LEFT JOIN s ON step >= a AND step < z GROUP BY step""",
    "exact_event_percentiles": "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 9) AS {n}" for n, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99))) + " FROM events GROUP BY event_type",
}
