"""Queries on episodes: the transition layout, indices, runs, selections, maps and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.render import nth_episode
from episodica.operators import episodes, selection
from episodica.operators.schema import nested, without_text
from episodica.plans.steps import EVENTS_SQL, LINES_SQL, TURNS_SQL, event_steps, line_steps, turn_steps
from episodica.sources.tables import table
from episodica.sources.tabular import episode_ids, tabular_steps


def ted_next_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next event's observation beside the own; the last one's own."""
    found = episodes.to_transitions(event_steps(spark, sf_dir), ["value", "event_type"])
    return found.select(
        "episode_id",
        "step",
        F.col("observation.value").alias("value"),
        F.col("next.observation.value").alias("next_value"),
        F.col("next.observation.event_type").alias("next_type"),
    )


def ted_done_terminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by position, and overridden by a column of the source."""
    steps = event_steps(spark, sf_dir)
    plain = episodes.to_transitions(steps, ["value"]).select("episode_id", "step", "done", "terminated")
    own = episodes.to_transitions(steps.withColumn("is_terminal", F.col("event_type") == "error"), ["value"])
    return plain.join(own.select("episode_id", "step", F.col("terminated").alias("terminated_by_error")), ["episode_id", "step"])


def ted_reward_action_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward 0 and action [0] where a source has none."""
    found = episodes.to_transitions(turn_steps(spark, sf_dir), ["text"], extras=["role"])
    return found.select(
        "episode_id", "step", F.col("next.reward").cast("double").alias("reward"), F.get("action", F.lit(0)).cast("double").alias("action_0"), F.size("action").cast("bigint").alias("n_action"), "role"
    )


def ted_full_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the layout over order lines."""
    steps = line_steps(spark, sf_dir).withColumns({"reward": F.col("l_extendedprice"), "action": F.array(F.col("l_discount"), F.col("l_tax"))})
    found = episodes.to_transitions(steps, ["l_quantity", "l_partkey"], extras=["l_returnflag"])
    return found.select(
        "episode_id",
        "step",
        F.col("observation.l_quantity").alias("quantity"),
        F.col("next.observation.l_quantity").alias("next_quantity"),
        F.col("next.observation.l_partkey").alias("next_partkey"),
        F.get("action", F.lit(0)).alias("action_0"),
        F.get("action", F.lit(1)).alias("action_1"),
        F.col("next.reward").cast("double").alias("reward"),
        "done",
        "terminated",
        F.col("next.done").alias("next_done"),
        "l_returnflag",
    )


def single_step_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one line are done at once, and their next observation is their own."""
    found = episodes.to_transitions(line_steps(spark, sf_dir).where("ep_len = 1"), ["l_quantity"])
    return found.select("episode_id", "step", "done", F.col("next.observation.l_quantity").alias("next_quantity"))


def episode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and length of every user's events laid end to end."""
    return episodes.episode_index(event_steps(spark, sf_dir))


def episode_rle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types."""
    return episodes.runs(event_steps(spark, sf_dir), "event_type").select("episode_id", "event_type", "run_start", "run_len")


def flat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every event in all episodes."""
    return episodes.with_flat_index(event_steps(spark, sf_dir, by_day=True)).select("event_id", "flat_index")


def num_episodes_total_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes and steps of two sources."""
    count = lambda df, name: df.agg(F.count_distinct("episode_id").alias("n_episodes"), F.count("*").alias("n_steps")).withColumn("source", F.lit(name))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"))
    return count(events, "events").unionByName(count(lines, "lineitem"))


def episode_selection_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users that have made an error, before any of their steps is numbered."""
    wanted = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("episode_id"))
    rows = table(spark, sf_dir, "events").withColumn("episode_id", F.col("user_id"))
    return episodes.number_steps(selection.select_episodes(rows, wanted), "user_id", ["ts", "event_id"]).select("episode_id", "step", "event_id")


def missing_episodes_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without a conversation of their number."""
    wanted = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"))
    return selection.missing_episodes(wanted, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id")))


def selection_key_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of the set of all users."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"))
    return selection.selection_key(users)


def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two types, as rows of two tasks."""
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "task")
    return selection.filter_tasks(rows, ["click", "error"]).select("event_id", "user_id", "task")


def task_and_episode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the users that are customers of a segment."""
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("episode_id"))
    rows = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "task", "user_id": "episode_id"})
    return selection.select_episodes(selection.filter_tasks(rows, ["click", "error"]), wanted).select("event_id", "episode_id", "task")


def distinct_episode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode ids of order lines."""
    return episode_ids(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_index")))


def frame_sort_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines numbered within their order."""
    return line_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "l_linenumber", "l_partkey", "l_extendedprice")


def dot_to_nested_lift_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with dotted names as nested steps, results of a step lifted."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_index"),
        F.col("event_id").alias("frame_index"),
        F.col("value").alias("observation.state"),
        F.col("event_type").alias("observation.kind"),
        F.col("value").alias("next.reward"),
        (F.col("event_type") == "error").alias("next.done"),
        F.lit(1).alias("task_index"),
    )
    found = tabular_steps(rows)
    return found.select(
        "episode_id", "step", F.col("observation.state").alias("state"), F.col("observation.kind").alias("kind"), "reward", "is_last", F.lit(len(found.columns)).cast("bigint").alias("n_columns")
    )


def drop_string_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as observations, without their text leaves."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("episode_id"), F.col("text").alias("observation.text"), F.col("lang").alias("observation.meta.lang"), F.col("n_chars").alias("observation.meta.n_chars")
    )
    found = without_text(nested(docs))
    leaves = [f.name for f in found.schema["observation"].dataType]
    return found.select("episode_id", F.col("observation.meta.n_chars").alias("n_chars"), F.lit(",".join(leaves)).alias("leaves"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("task_id"), F.col("c_custkey").alias("episode_id"))


def global_episode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers numbered by nation."""
    return selection.global_episode_map(_tasks(spark, sf_dir))


def episode_map_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of the nations of one region, extended by the others."""
    region = table(spark, sf_dir, "region").where("r_name = 'ASIA'")
    nations = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    tasks = _tasks(spark, sf_dir)
    known = selection.global_episode_map(tasks.join(nations.select(F.col("n_nationkey").alias("task_id")), "task_id", "left_semi"))
    return selection.extend_episode_map(known, tasks)


def tar_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts looked up in overlapping archives of their size; some names do not parse."""
    parts = table(spark, sf_dir, "part")
    edges = parts.select(F.col("p_size").alias("s"), (F.floor(F.col("p_partkey") / 100) * 100).alias("b")).distinct()
    listed = edges.select(
        (F.col("s") * 1_000_000 + F.col("b")).alias("position"),
        F.when(F.col("b") % 300 == 0, F.concat_ws("/", F.lit("obs"), "s", F.concat("b", F.lit("-x.tar"))))
        .otherwise(F.concat_ws("/", F.lit("obs"), "s", F.concat("b", F.lit("-"), F.col("b") + 150, F.lit(".tar"))))
        .alias("path"),
    )
    wanted = parts.select(F.col("p_size").alias("task_id"), F.col("p_partkey").alias("episode_id"))
    return selection.find_archives(wanted, selection.archives_of(listed))


#: Segments of skills that overlap and leave gaps, for every user.
SEGMENTS = ((0, 0, 10, "reach"), (1, 5, 20, "grasp"), (2, 25, 40, "lift"), (3, 30, 35, "hold"), (4, None, 3, "late"))


def skill_interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first skill whose segment holds an event."""
    steps = event_steps(spark, sf_dir).select("episode_id", "step")
    rows = ", ".join(f"({p}, {'cast(null as int)' if a is None else a}, {b}, '{t}')" for p, a, b, t in SEGMENTS)
    segments = spark.sql(f"SELECT * FROM VALUES {rows} AS s(position, start_frame, end_frame, action_text)")
    array = F.transform(F.sort_array(F.collect_list(F.struct("position", "start_frame", "end_frame", "action_text"))), lambda s: s)
    listed = segments.agg(array.alias("segments"))
    return steps.crossJoin(F.broadcast(listed)).select("episode_id", "step", selection.skill_in(F.col("step"), F.col("segments")).alias("skill"))


def camera_min_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event types as cameras of a user: frames that both have."""
    events = table(spark, sf_dir, "events")
    cameras = {
        kind: episodes.number_steps(events.where(F.col("event_type") == kind), "user_id", ["ts", "event_id"]) for kind in ("click", "view")
    }
    return selection.align_cameras(cameras)


def episode_slice_negative_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the second-last user."""
    return nth_episode(event_steps(spark, sf_dir), -2).select("episode_id", "step", "event_id", "value")


QUERIES = {
    f.__name__: f
    for f in (
        ted_next_observation,
        ted_done_terminated,
        ted_reward_action_defaults,
        ted_full_transition,
        single_step_episode,
        episode_index,
        episode_rle_islands,
        flat_index,
        num_episodes_total_steps,
        episode_selection_semi,
        missing_episodes_anti,
        selection_key_md5,
        task_filter,
        task_and_episode_filter,
        distinct_episode_ids,
        frame_sort_group,
        dot_to_nested_lift_next,
        drop_string_fields,
        global_episode_map,
        episode_map_extension,
        tar_range_lookup,
        skill_interval_lookup,
        camera_min_alignment,
        episode_slice_negative_index,
    )
}

_NEXT = "coalesce(lead({0}) OVER (PARTITION BY episode_id ORDER BY step), {0})"
_SKILLS = " ".join(f"WHEN step >= {a or 0} AND step < {b} THEN '{t}'" for _, a, b, t in SEGMENTS)
ORACLE_SQL = {
    "ted_next_observation": f"WITH {EVENTS_SQL} SELECT episode_id, step, value, {_NEXT.format('value')} AS next_value, {_NEXT.format('event_type')} AS next_type FROM ev",
    "ted_done_terminated": f"WITH {EVENTS_SQL} SELECT episode_id, step, step = ep_len - 1 AS done, step = ep_len - 1 AS terminated, event_type = 'error' AS terminated_by_error FROM ev",
    "ted_reward_action_defaults": f"WITH {TURNS_SQL} SELECT episode_id, step, 0.0::DOUBLE AS reward, 0.0::DOUBLE AS action_0, 1::BIGINT AS n_action, role FROM tn",
    "ted_full_transition": f"""WITH {LINES_SQL} SELECT episode_id, step, l_quantity AS quantity, {_NEXT.format('l_quantity')} AS next_quantity,
  {_NEXT.format('l_partkey')} AS next_partkey, l_discount AS action_0, l_tax AS action_1, l_extendedprice::FLOAT::DOUBLE AS reward,
  step = ep_len - 1 AS done, step = ep_len - 1 AS terminated, step = ep_len - 1 AS next_done, l_returnflag FROM ln""",
    "single_step_episode": f"WITH {LINES_SQL} SELECT episode_id, step, true AS done, l_quantity AS next_quantity FROM ln WHERE ep_len = 1",
    "episode_index": """SELECT user_id AS episode_id, (sum(n) OVER (ORDER BY user_id) - n)::BIGINT AS ep_start, n AS ep_len
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""",
    "episode_rle_islands": f"""WITH {EVENTS_SQL}, c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY episode_id ORDER BY step))::INT AS new FROM ev),
r AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY step) AS run FROM c)
SELECT episode_id, event_type, min(step) AS run_start, count(*) AS run_len FROM r GROUP BY episode_id, run, event_type""",
    "flat_index": "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS flat_index FROM events",
    "num_episodes_total_steps": """SELECT count(DISTINCT user_id) AS n_episodes, count(*) AS n_steps, 'events' AS source FROM events
UNION ALL SELECT count(DISTINCT l_orderkey), count(*), 'lineitem' FROM lineitem""",
    "episode_selection_semi": f"WITH {EVENTS_SQL} SELECT episode_id, step, event_id FROM ev WHERE episode_id IN (SELECT user_id FROM events WHERE event_type = 'error')",
    "missing_episodes_anti": "SELECT DISTINCT user_id AS episode_id FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)",
    "selection_key_md5": """SELECT substr(md5(string_agg(u::VARCHAR, ',' ORDER BY u)), 1, 16) AS selection_key, count(*) AS n_episodes
FROM (SELECT DISTINCT user_id AS u FROM events)""",
    "task_filter": "SELECT event_id, user_id, event_type AS task FROM events WHERE event_type IN ('click', 'error')",
    "task_and_episode_filter": "SELECT event_id, user_id AS episode_id, event_type AS task FROM events WHERE event_type IN ('click', 'error') AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "distinct_episode_ids": "SELECT DISTINCT l_orderkey AS episode_id FROM lineitem",
    "frame_sort_group": f"WITH {LINES_SQL} SELECT episode_id, step, ep_len, l_linenumber, l_partkey, l_extendedprice FROM ln",
    "dot_to_nested_lift_next": """SELECT user_id AS episode_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS step,
  value AS state, event_type AS kind, value AS reward, event_type = 'error' AS is_last, 6::BIGINT AS n_columns FROM events""",
    "drop_string_fields": "SELECT doc_id AS episode_id, n_chars, 'meta' AS leaves FROM documents",
    "global_episode_map": "SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS global_id, c_nationkey AS task_id, c_custkey AS episode_id FROM customer",
    "episode_map_extension": """SELECT row_number() OVER (ORDER BY r_name <> 'ASIA', c_nationkey, c_custkey) - 1 AS global_id, c_nationkey AS task_id, c_custkey AS episode_id
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "tar_range_lookup": """WITH e AS (SELECT DISTINCT p_size AS s, p_partkey // 100 * 100 AS b FROM part)
SELECT p_size AS task_id, p_partkey AS episode_id,
  arg_min('obs/' || s || '/' || b || '-' || (b + 150) || '.tar', b) AS path
FROM part LEFT JOIN e ON e.s = p_size AND b % 300 <> 0 AND p_partkey BETWEEN b AND b + 150 GROUP BY p_size, p_partkey""",
    "skill_interval_lookup": f"WITH {EVENTS_SQL} SELECT episode_id, step, CASE {_SKILLS} ELSE '' END AS skill FROM ev",
    "camera_min_alignment": """WITH c AS (SELECT user_id AS episode_id, event_type, value, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1)::INT AS step
  FROM events WHERE event_type IN ('click', 'view'))
SELECT episode_id, step, a.value AS value_click, b.value AS value_view FROM (SELECT * FROM c WHERE event_type = 'click') a
JOIN (SELECT * FROM c WHERE event_type = 'view') b USING (episode_id, step)""",
    "episode_slice_negative_index": f"""WITH {EVENTS_SQL} SELECT episode_id, step, event_id, value FROM ev
WHERE episode_id = (SELECT DISTINCT user_id FROM events ORDER BY user_id DESC LIMIT 1 OFFSET 1)""",
}
