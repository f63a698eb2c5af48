"""Step tables that queries read, and the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators.episodes import number_steps
from episodica.sources.tables import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def event_steps(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    """Users as episodes of their events; ``by_day`` numbers long ones day by day.

    Windows need an episode's rows together anyway and share one exchange with plain numbering.
    """
    return number_steps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.to_date("ts") if by_day else None)


def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes of their lines."""
    return number_steps(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE_ORDER)


def turn_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes of their turns."""
    return number_steps(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])


EVENTS_SQL = """ev AS (
  SELECT *, user_id AS episode_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS step,
         (count(*) OVER (PARTITION BY user_id))::INT AS ep_len FROM events)"""
LINES_SQL = f"""ln AS (
  SELECT *, l_orderkey AS episode_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1)::INT AS step,
         (count(*) OVER (PARTITION BY l_orderkey))::INT AS ep_len FROM lineitem)"""
TURNS_SQL = """tn AS (
  SELECT *, conv_id AS episode_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS step,
         (count(*) OVER (PARTITION BY conv_id))::INT AS ep_len FROM conversations)"""
