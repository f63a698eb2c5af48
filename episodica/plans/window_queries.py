"""Queries on windows, tubelets and drawn batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import sampling
from episodica.operators.episodes import with_flat_index
from episodica.operators.tubelets import TubeletGrid, tubelet_steps, tubelets
from episodica.operators.windows import TemporalWindow, batch_windows, long_windows
from episodica.plans.steps import EVENTS_SQL, LINES_SQL, TURNS_SQL, event_steps, line_steps, turn_steps
from episodica.sources.tables import table

HISTORY = TemporalWindow({"value": [-0.2, -0.1, 0.0]})
UNSORTED = TemporalWindow({"value": [0.1, -0.3, 0.1]})
WIDE = TemporalWindow({"quantity": [-0.5, -0.1, 0.0, 0.1, 0.2]})
GRID = TubeletGrid(8, 16, 0.2)
SEED, DRAWS = 7, 64


def _window_sql(steps: str, name: str, outputs: dict[str, tuple[str, list[int]]], extra: str = "") -> str:
    """Self-joins at clamped steps, one per output."""
    n = len(next(iter(outputs.values()))[1])
    joins, columns = [], []
    for k, (out, (leaf, offsets)) in enumerate(outputs.items()):
        joins.append(
            f"JOIN {name} s{k} ON s{k}.episode_id = a.episode_id AND"
            f" s{k}.step = greatest(0, least(a.ep_len - 1, a.step + ([{', '.join(map(str, offsets))}])[o.t + 1]))"
        )
        columns.append(f"s{k}.{leaf} AS {out}")
    return f"""WITH {steps}, o AS (SELECT unnest(range({n}))::INT AS t)
SELECT a.episode_id, a.step, o.t, {extra}{", ".join(columns)} FROM {name} a CROSS JOIN o {" ".join(joins)}"""


_OBS = {"value": ("value", HISTORY.offsets("value"))}
_NEXT = {"next_value": ("value", HISTORY.next_offsets("value"))}
_BOTH = _OBS | _NEXT
_UNSORTED = {"value": ("value", UNSORTED.offsets("value")), "next_value": ("value", UNSORTED.next_offsets("value"))}
_SHORT = {"quantity": ("l_quantity", WIDE.offsets("quantity")), "next_quantity": ("l_quantity", WIDE.next_offsets("quantity"))}
_TEXT = {"n_chars": ("n_chars", [-1, 0, 1])}


def temporal_window_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History window and mirrored next window around every event."""
    return long_windows(event_steps(spark, sf_dir), _BOTH)


def temporal_window_next_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirrored next window alone."""
    return long_windows(event_steps(spark, sf_dir), _NEXT)


def temporal_window_unsorted_dup_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets out of order and twice stay as given; the mirrored ones are sorted."""
    return long_windows(event_steps(spark, sf_dir), _UNSORTED)


def temporal_window_short_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows wider than most episodes."""
    return long_windows(line_steps(spark, sf_dir), _SHORT)


def temporal_window_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A windowed number beside a text leaf that stays at its anchor."""
    turns = turn_steps(spark, sf_dir).withColumn("n_chars", F.length("text"))
    return long_windows(turns, _TEXT, ("text",))


def window_half_even_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of event values as seconds at 10 steps a second and half of it."""
    steps = event_steps(spark, sf_dir)
    half = F.floor(F.col("value")) / 2
    return steps.select("event_id", F.bround(half, 0).cast("bigint").alias("offset_half"), F.bround(F.col("value") * 10, 0).cast("bigint").alias("offset_tenth"))


def _event_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    steps = event_steps(spark, sf_dir)
    return steps, steps.select("episode_id", "ep_len").distinct()


def tubelet_grid_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of eight clips over every user's events."""
    return tubelet_steps(_event_index(spark, sf_dir)[1], GRID)


def tubelet_grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the leaves at each frame."""
    steps, episodes = _event_index(spark, sf_dir)
    return tubelets(steps.select("episode_id", "step", "ep_len", "value", "event_type"), episodes, GRID)


def tubelet_single_clip_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip is the last that fits."""
    steps = turn_steps(spark, sf_dir)
    clips = tubelets(steps.select("episode_id", "step", "ep_len", "role"), steps.select("episode_id", "ep_len").distinct(), TubeletGrid(1, 3, 0.1))
    return clips.select("episode_id", "clip", "t", "step", "role")


def hash_anchor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors drawn by a seed."""
    return sampling.draw_anchors(event_steps(spark, sf_dir), DRAWS, SEED).select("b", "episode_id", "anchor_step")


def hash_anchor_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn batch with its history and its mirrored next window, in long form."""
    steps = event_steps(spark, sf_dir, by_day=True)
    batch = batch_windows(steps.select("episode_id", "step", "ep_len", "value"), sampling.draw_anchors(steps, DRAWS, SEED), HISTORY, DRAWS)
    pairs = F.arrays_zip(F.col("value"), F.col("`next/value`").alias("next_value"))
    return batch.select("b", F.posexplode(pairs).alias("t", "w")).select("b", "t", "w.*")


def hash_episode_pick_tubelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tubelets of a drawn episode."""
    steps = event_steps(spark, sf_dir)
    clips = tubelets(steps.select("episode_id", "step", "ep_len", "value"), sampling.draw_episode(steps, SEED), TubeletGrid(3, 3, 0.2))
    return clips.select("episode_id", "clip", "t", "step", "value")


def row_by_flat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps at the places in all episodes that another table asks for."""
    flat = with_flat_index(event_steps(spark, sf_dir, by_day=True))
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("flat_index"))
    return flat.join(wanted, "flat_index", "left_semi").select("flat_index", "episode_id", "step", "event_id")


_GRID_SQL = f"""g AS (
  SELECT e.episode_id, c.clip, f.t,
         least(e.ep_len - 1, round_even(c.clip * greatest(0, e.ep_len - 1 - {(GRID.frames - 1) * GRID.stride}) / {GRID.clips - 1}.0, 0)::INT + f.t * {GRID.stride})::INT AS step
  FROM (SELECT DISTINCT episode_id, ep_len FROM ev) e, (SELECT unnest(range({GRID.clips}))::INT AS clip) c, (SELECT unnest(range({GRID.frames}))::INT AS t) f)"""
_DRAWN_SQL = f"""fl AS (SELECT *, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat FROM ev), an AS (
  SELECT b, fl.episode_id, fl.step AS anchor_step, fl.ep_len
  FROM (SELECT b, cast(concat('0x', substr(md5(concat('{SEED}:', b::VARCHAR)), 1, 15)) AS BIGINT) % (SELECT count(*) FROM ev) AS flat
        FROM (SELECT unnest(range({DRAWS})) AS b)) JOIN fl USING (flat))"""

QUERIES = {
    f.__name__: f
    for f in (
        temporal_window_obs,
        temporal_window_next_mirror,
        temporal_window_unsorted_dup_offsets,
        temporal_window_short_episodes,
        temporal_window_text,
        window_half_even_rounding,
        tubelet_grid_indices,
        tubelet_grid_values,
        tubelet_single_clip_end,
        hash_anchor_sample,
        hash_anchor_window_batch,
        hash_episode_pick_tubelet,
        row_by_flat_index,
    )
}
ORACLE_SQL = {
    "temporal_window_obs": _window_sql(EVENTS_SQL, "ev", _BOTH),
    "temporal_window_next_mirror": _window_sql(EVENTS_SQL, "ev", _NEXT),
    "temporal_window_unsorted_dup_offsets": _window_sql(EVENTS_SQL, "ev", _UNSORTED),
    "temporal_window_short_episodes": _window_sql(LINES_SQL, "ln", _SHORT),
    "temporal_window_text": _window_sql(
        TURNS_SQL.replace("SELECT *,", "SELECT *, length(text)::INT AS n_chars,"), "tn", _TEXT, "a.text, "
    ),
    "window_half_even_rounding": f"WITH {EVENTS_SQL} SELECT event_id, round_even(floor(value) / 2, 0)::BIGINT AS offset_half,"
    " round_even(value * 10, 0)::BIGINT AS offset_tenth FROM ev",
    "tubelet_grid_indices": f"WITH {EVENTS_SQL}, {_GRID_SQL} SELECT * FROM g",
    "tubelet_grid_values": f"WITH {EVENTS_SQL}, {_GRID_SQL} SELECT g.*, value, event_type FROM g JOIN ev USING (episode_id, step)",
    "tubelet_single_clip_end": f"""WITH {TURNS_SQL} SELECT a.episode_id, 0 AS clip, t, b.step, b.role
FROM (SELECT DISTINCT episode_id, ep_len FROM tn) a CROSS JOIN (SELECT unnest(range(3))::INT AS t)
JOIN tn b ON b.episode_id = a.episode_id AND b.step = least(a.ep_len - 1, greatest(0, a.ep_len - 3) + t)""",
    "hash_anchor_sample": f"WITH {EVENTS_SQL}, {_DRAWN_SQL} SELECT b, episode_id, anchor_step FROM an",
    "hash_anchor_window_batch": f"""WITH {EVENTS_SQL}, {_DRAWN_SQL}
SELECT b, t, x.value, y.value AS next_value FROM an CROSS JOIN (SELECT unnest(range(3))::INT AS t)
JOIN ev x ON x.episode_id = an.episode_id AND x.step = greatest(0, least(an.ep_len - 1, anchor_step + t - 2))
JOIN ev y ON y.episode_id = an.episode_id AND y.step = greatest(0, least(an.ep_len - 1, anchor_step + t))""",
    "hash_episode_pick_tubelet": f"""WITH {EVENTS_SQL}, e AS (
  SELECT episode_id, ep_len FROM (SELECT DISTINCT episode_id, ep_len FROM ev) ORDER BY md5(concat('{SEED}:', episode_id::VARCHAR)), episode_id LIMIT 1)
SELECT ev.episode_id, clip, t, ev.step, value
FROM e CROSS JOIN (SELECT unnest(range(3))::INT AS clip) CROSS JOIN (SELECT unnest(range(3))::INT AS t)
JOIN ev ON ev.episode_id = e.episode_id AND ev.step = least(e.ep_len - 1, round_even(clip * greatest(0, e.ep_len - 5) / 2.0, 0)::INT + 2 * t)""",
    "row_by_flat_index": f"""WITH {EVENTS_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat_index FROM ev)
SELECT flat_index, episode_id, step, event_id FROM f WHERE flat_index IN (SELECT p_partkey FROM part)""",
}
