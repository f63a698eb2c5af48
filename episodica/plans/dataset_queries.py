"""Queries on stores that are written twice or in parts, on samples of images, and on leaves and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.dataset import TrajectoryDataset
from episodica.functions import names, tensors
from episodica.functions.render import colour_frames
from episodica.operators.episodes import explode_episodes, flat_episode, number_steps, to_transitions
from episodica.operators.schema import flattened, nested
from episodica.operators.selection import skill_at
from episodica.plans.steps import EVENTS_SQL, TURNS_SQL, event_steps, turn_steps
from episodica.plans.store_queries import fresh
from episodica.sources.store import EpisodeStore
from episodica.sources.tables import table
from episodica.sources.tasks import task_ids
from episodica.streaming.ingest import ingest

SIDE, SEED, DRAWS = 4, 7, 64
SHARES = {"train": 0.7, "val": 0.2, "test": 0.1}

#: Segments of skills; every other user has each of them.
SEGMENTS = ((0, 0, 10, "reach"), (1, 5, 20, "grasp"), (2, 25, 40, "lift"), (3, None, 3, "late"))


class _Stopped(EpisodeStore):
    """A store whose writes end before the manifest names them."""

    def _name(self, part: str, batch: str, fresh: DataFrame) -> None:
        return None


def store_repeated_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build that stops before its manifest, then twice the same build: every step is stored once."""
    steps = event_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "event_id")
    root, wanted = fresh(spark, "store"), steps.select("episode_id").distinct()
    _Stopped(spark, root).build(steps, wanted, "first")
    for _ in range(2):
        EpisodeStore(spark, root).build(steps, wanted, "first")
    return EpisodeStore(spark, root).read().select("episode_id", "step", "event_id", "flat_index")


def store_selected_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the users with a conversation, read from a store of all."""
    steps = event_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "event_id")
    store = EpisodeStore(spark, fresh(spark, "store"))
    store.build(steps, steps.select("episode_id").distinct(), "all")
    talking = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"))
    return store.read(talking.join(steps.select("episode_id").distinct(), "episode_id", "left_semi")).select("episode_id", "step", "flat_index")


def stream_split_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns come in different micro-batches, some of them twice."""
    steps = turn_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "role")
    source, state = fresh(spark, "stream-in"), fresh(spark, "stream-state")
    steps.repartition(3, "step").write.parquet(source)
    steps.where("step < 2").coalesce(1).write.mode("append").parquet(source)
    store = EpisodeStore(spark, fresh(spark, "stream-store"))
    ingest(spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(source), store, state).awaitTermination()
    return store.read().select("episode_id", "step", "role", "flat_index")


def _image_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = number_steps(table(spark, sf_dir, "embeddings"), "label", ["vec_id"])
    shape = {"shape": [SIDE, SIDE, SIDE]}
    return steps.select("episode_id", "step", "ep_len", F.col("embedding").alias("image", metadata=shape), "vec_id")


def sample_image_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn batch of whole vectors as 4 x 4 x 4 images with one earlier frame, channels first."""
    batch = TrajectoryDataset(_image_steps(spark, sf_dir)).with_windows({"image": [-0.1, 0.0]}).sample(DRAWS, SEED)
    frames = batch.select("b", F.posexplode("image").alias("t", "frame"))
    return frames.select("b", "t", F.posexplode("frame").alias("k", "value")).withColumn("value", F.col("value").cast("double"))


def default_window_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that a drawn batch has of every leaf under the default windows and one of the caller's."""
    steps = to_transitions(event_steps(spark, sf_dir), ["value"], extras=["event_type"])
    batch = TrajectoryDataset(steps).with_windows({"action": [0.0, 0.1, 0.2]}).sample(DRAWS, SEED)
    n = lambda c: F.size(F.col(f"`{c}`")).cast("bigint")
    return batch.select("b", "episode_id", n("observation/value").alias("n_value"), n("action").alias("n_action"), n("next/action").alias("n_next"), "event_type")


def skill_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first segment that holds an event, from a table of every other user's segments."""
    steps = event_steps(spark, sf_dir).select("episode_id", "step")
    rows = ", ".join(f"({p}, {'cast(null as int)' if a is None else a}, {b}, '{t}')" for p, a, b, t in SEGMENTS)
    kinds = spark.sql(f"SELECT * FROM VALUES {rows} AS s(position, start_frame, end_frame, action_text)")
    users = steps.select("episode_id").distinct()
    segments = users.crossJoin(F.broadcast(kinds)).where((F.col("episode_id") + F.col("position")) % 2 == 0)
    return skill_at(steps, segments).select("episode_id", "step", "skill")


def nested_episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested episodes, and their steps again."""
    turns = table(spark, sf_dir, "conversations")
    episodes = turns.groupBy(F.col("conv_id").alias("episode_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("steps"))
    return explode_episodes(episodes).select("episode_id", "step", "ep_len", "turn", "role")


def single_step_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as episodes of one step, done by position."""
    found = to_transitions(flat_episode(table(spark, sf_dir, "customer"), "c_custkey"), ["c_acctbal"], extras=["c_name"])
    return found.select("episode_id", "step", "ep_len", F.col("next.observation.c_acctbal").alias("next_balance"), "done", "c_name")


def leaf_text_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of texts as text; every third has a byte that is no UTF-8 and stays without."""
    data = F.encode("text", "UTF-8")
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(data, F.unhex(F.lit("FF")))).otherwise(data)
    return table(spark, sf_dir, "documents").select("doc_id", names.utf8_or_null(broken).alias("text"))


def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted columns as structs, and their leaves by path."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("observation.arm.quantity"), F.col("l_tax").alias("observation.tax"))
    return flattened(nested(lines)).withColumnsRenamed({"observation/arm/quantity": "quantity", "observation/tax": "tax"})


def gray_to_rgb_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every vector three times."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(tensors.gray_to_rgb(F.col("embedding").cast("array<double>"))).alias("k", "value"))


def colour_frame_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors as gray 8 x 8 frames, stretched and coloured."""
    clips = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), F.lit(0).alias("t"), "embedding")
    return colour_frames(clips, "embedding", (8, 8, 1)).select(F.col("clip").alias("vec_id"), F.posexplode("rgb").alias("k", "code"))


def task_ids_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task ids of file names; names of another form give none."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "task_info/task_").otherwise("other/task_"), F.col("p_size").cast("string"), F.lit(".json"))
    return task_ids(part.select(name.alias("path")))


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and events of disjoint splits, dealt by hash."""
    parts = TrajectoryDataset(event_steps(spark, sf_dir)).splits(SHARES)
    sizes = [p.steps.groupBy(F.lit(name).alias("split")).agg(F.count_distinct("episode_id").alias("episodes"), F.count("*").alias("steps")) for name, p in parts.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


QUERIES = {
    f.__name__: f
    for f in (
        store_repeated_build,
        store_selected_read,
        stream_split_episodes,
        sample_image_chw,
        default_window_modalities,
        skill_segment_join,
        nested_episode_steps,
        single_step_episodes,
        leaf_text_conversion,
        nested_leaves,
        gray_to_rgb_values,
        colour_frame_codes,
        task_ids_of_files,
        split_sizes,
    )
}

_DRAW = f"cast(concat('0x', substr(md5(concat('{SEED}:', b::VARCHAR)), 1, 15)) AS BIGINT)"
_SKILLS = " ".join(f"WHEN (episode_id + {p}) % 2 = 0 AND step >= {a or 0} AND step < {b} THEN '{t}'" for p, a, b, t in SEGMENTS)
_LIMITS = [sum(list(SHARES.values())[:k]) for k in range(len(SHARES) + 1)]
_SPLITS = " ".join(f"WHEN share >= {_LIMITS[k]!r}::DOUBLE AND share < {_LIMITS[k]!r}::DOUBLE + {s!r}::DOUBLE THEN '{n}'" for k, (n, s) in enumerate(SHARES.items()))
ORACLE_SQL = {
    "store_repeated_build": f"WITH {EVENTS_SQL} SELECT episode_id, step, event_id, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat_index FROM ev",
    "store_selected_read": f"""WITH {EVENTS_SQL} SELECT episode_id, step, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat_index FROM ev
WHERE episode_id IN (SELECT conv_id FROM conversations)""",
    "stream_split_episodes": f"WITH {TURNS_SQL} SELECT episode_id, step, role, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat_index FROM tn",
    "sample_image_chw": f"""WITH s AS (SELECT embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step,
    row_number() OVER (ORDER BY label, vec_id) - 1 AS flat FROM embeddings),
d AS (SELECT b, {_DRAW} % (SELECT count(*) FROM s) AS flat FROM (SELECT unnest(range({DRAWS})) AS b)),
f AS (SELECT b, t::INT AS t, y.embedding FROM d JOIN s x USING (flat) CROSS JOIN (SELECT unnest([0, 1]) AS t) JOIN s y ON y.label = x.label AND y.step = greatest(0, x.step - 1 + t))
SELECT b, t, (c * {SIDE * SIDE} + p)::INT AS k, embedding[p * {SIDE} + c + 1]::DOUBLE AS value
FROM f, (SELECT unnest(range({SIDE})) AS c), (SELECT unnest(range({SIDE * SIDE})) AS p)""",
    "default_window_modalities": f"""WITH {EVENTS_SQL}, fl AS (SELECT *, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat FROM ev)
SELECT b, episode_id, 1::BIGINT AS n_value, 3::BIGINT AS n_action, 3::BIGINT AS n_next, event_type
FROM (SELECT b, {_DRAW} % (SELECT count(*) FROM ev) AS flat FROM (SELECT unnest(range({DRAWS})) AS b)) JOIN fl USING (flat)""",
    "skill_segment_join": f"WITH {EVENTS_SQL} SELECT episode_id, step, CASE {_SKILLS} ELSE '' END AS skill FROM ev",
    "nested_episode_steps": f"WITH {TURNS_SQL} SELECT episode_id, step, ep_len, turn, role FROM tn",
    "single_step_episodes": "SELECT c_custkey AS episode_id, 0 AS step, 1 AS ep_len, c_acctbal AS next_balance, true AS done, c_name FROM customer",
    "leaf_text_conversion": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN text END AS text FROM documents",
    "nested_leaves": "SELECT l_orderkey, l_quantity AS quantity, l_tax AS tax FROM lineitem",
    "gray_to_rgb_values": "SELECT vec_id, k::INT AS k, embedding[k // 3 + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(192)) AS k)",
    "colour_frame_codes": """WITH c AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(64)) AS k)),
r AS (SELECT quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.99::DOUBLE) AS hi FROM c)
SELECT vec_id, (3 * k + j)::INT AS k, floor(greatest(0.0, least(1.0, (value - lo) / greatest(hi - lo, 1e-6::DOUBLE))) * 255)::INT AS code
FROM c, r, (SELECT unnest([0, 1, 2]) AS j)""",
    "task_ids_of_files": "SELECT DISTINCT p_size::BIGINT AS task_id FROM part WHERE p_partkey % 2 = 0",
    "split_sizes": f"""WITH s AS (SELECT user_id, cast(concat('0x', substr(md5(concat('0:', user_id::VARCHAR)), 1, 8)) AS BIGINT)::DOUBLE / 4294967296 AS share FROM events),
p AS (SELECT user_id, CASE {_SPLITS} END AS split FROM s)
SELECT split, count(DISTINCT user_id) AS episodes, count(*) AS steps FROM p WHERE split IS NOT NULL GROUP BY split""",
}
