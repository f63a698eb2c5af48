"""Rows of tabular datasets as steps of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.operators.episodes import number_steps
from episodica.operators.schema import nested
from episodica.operators.selection import episode_column

#: Columns that only keep books in tabular sources, and where results of a step go.
META_COLUMNS = ("episode_index", "episode_id", "frame_index", "timestamp", "index", "task_index", "task_id", "traj_id", "trajectory_id")
LIFTED = (("next.reward", "reward"), ("next.done", "is_last"), ("next.terminated", "is_terminal"))


def lift_next(rows: DataFrame) -> DataFrame:
    """``next.reward``, ``next.done`` and ``next.terminated`` under the names of steps, unless those exist; no other ``next.`` column."""
    columns = set(rows.columns)
    lifted = [F.col(f"`{old}`").alias(new) for old, new in LIFTED if old in columns and new not in columns]
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("next.")], *lifted)


def tabular_steps(rows: DataFrame) -> DataFrame:
    """Numbered steps with nested columns; ordered by ``frame_index``, or ``index`` where there is none."""
    order = next((c for c in ("frame_index", "index", "timestamp") if c in rows.columns), None)
    if order is None:
        raise ValueError("rows without a column that orders frames")
    numbered = number_steps(rows, episode_column(rows.columns), [order])
    own = ("episode_id", "step", "ep_len")
    flat = lift_next(numbered)
    return nested(flat.select(*own, *[F.col(f"`{c}`") for c in flat.columns if c not in (*META_COLUMNS, *own)]))


def episode_ids(rows: DataFrame) -> DataFrame:
    """Distinct episode ids in order."""
    column = episode_column(rows.columns)
    return rows.select(F.col(column).alias("episode_id")).distinct().orderBy("episode_id")
