"""Steps of episodes: numbering, lengths, the episode index, runs, and the transition layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ranges of ids in which lengths are summed up, and positions per range of stored rows.
ID_RANGES = 1024
POSITIONS = 4096
#: Rank error of the ranges' bounds, as a share of all ids: a fraction of a range.
ACCURACY = 16 * ID_RANGES
#: Steps of an episode that one task windows, besides their neighbours'.
STRETCH = 1 << 18
_BEFORE = (W.unboundedPreceding, -1)


def number_steps(rows: DataFrame, episode: str, order: list[str], stretch: Column | None = None) -> DataFrame:
    """``rows`` with ``episode_id``, ``step`` from 0 and ``ep_len``.

    ``stretch``, an expression that does not decrease along ``order``, cuts long episodes into parts
    that are numbered on their own behind the lengths of earlier parts, so that no task needs to
    hold an episode.
    """
    named = rows.withColumn("episode_id", F.col(episode))
    if stretch is None:
        own = W.partitionBy("episode_id")
        return named.withColumns(
            {"step": (F.row_number().over(own.orderBy(*order)) - 1).cast("int"), "ep_len": F.count("*").over(own).cast("int")}
        )
    cut = named.withColumn("__stretch", stretch)
    sizes = cut.groupBy("episode_id", "__stretch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("episode_id").orderBy("__stretch").rowsBetween(*_BEFORE)), F.lit(0))
    placed = sizes.withColumns({"__before": before, "ep_len": F.sum("n").over(W.partitionBy("episode_id")).cast("int")}).drop("n")
    inside = W.partitionBy("episode_id", "__stretch").orderBy(*order)
    placed = placed.withColumnsRenamed({"episode_id": "__episode", "__stretch": "__part"})
    same = F.col("episode_id").eqNullSafe(F.col("__episode")) & F.col("__stretch").eqNullSafe(F.col("__part"))
    return (
        cut.join(placed, same)
        .withColumn("step", (F.row_number().over(inside) - 1 + F.col("__before")).cast("int"))
        .drop("__stretch", "__before", "__episode", "__part")
    )


def with_range(ids: DataFrame) -> DataFrame:
    """``ids`` with ``__range``: ranges in order of ``episode_id`` of about equally many ids, however they are spread.

    Bounds are quantiles of a sketch that every task adds its ids to; at most ``ID_RANGES`` of them come to the driver,
    so all that is made from the ranges sees the same ones. They are looked up in two steps.
    """
    shares = F.expr(f"array({', '.join(f'{k / ID_RANGES!r}D' for k in range(1, ID_RANGES))})")  # one expression, not a call for each
    found = ids.agg(F.percentile_approx(F.col("episode_id").cast("bigint"), shares, ACCURACY).alias("bounds")).first().bounds
    bounds = sorted(set(found or []))
    side = max(1, math.isqrt(len(bounds)))
    heads = bounds[::side]
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    groups = F.array(*[literal(bounds[k : k + side]) for k in range(0, max(1, len(bounds)), side)])
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("episode_id")))
    head = F.greatest(F.lit(1), below(literal(heads)))
    return ids.withColumn("__head", head).withColumn("__range", ((F.col("__head") - 1) * side + below(F.get(groups, F.col("__head") - 1))).cast("bigint")).drop("__head")


def with_neighbours(steps: DataFrame, back: int, ahead: int, stretch: int = STRETCH) -> DataFrame:
    """Rows of ``steps`` by stretches of their episode, and beside them the rows that windows of theirs reach.

    ``__stretch`` names a stretch of ``stretch`` steps and ``__own`` tells its rows from those of its neighbours: the
    steps from ``back`` before to ``ahead`` behind it. Inside an episode's stretch, rows follow one another without a
    gap, its first or last row is the episode's where a window reaches beyond it, and no task needs a whole episode.
    """
    at = lambda k: F.floor((F.col("step") + k) / stretch)
    last = F.floor((F.col("ep_len") - 1) / stretch)
    reached = F.sequence(F.greatest(F.lit(0), at(-max(0, ahead))), F.least(last, at(max(0, back))))
    dealt = steps.withColumn("__stretch", F.explode(reached))
    return dealt.withColumn("__own", F.col("__stretch") == at(0))


def index_of(lengths: DataFrame) -> DataFrame:
    """``episode_id, ep_start, ep_len`` with episodes laid end to end in order of their ids.

    ``lengths`` has ``episode_id, ep_len``. They are summed by ranges of ids, then inside each range.
    """
    cut = with_range(lengths)
    ranges = cut.groupBy("__range").agg(F.sum("ep_len").alias("n"))
    before = ranges.select("__range", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(*_BEFORE)), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__range").orderBy("episode_id").rowsBetween(*_BEFORE)
    start = F.col("__before") + F.coalesce(F.sum("ep_len").over(inside), F.lit(0))
    return cut.join(before, "__range").select("episode_id", start.alias("ep_start"), "ep_len")


def episode_index(steps: DataFrame) -> DataFrame:
    """``episode_id, ep_start, ep_len`` of the episodes of ``steps``."""
    return index_of(steps.groupBy("episode_id").agg(F.count("*").alias("ep_len")))


def flat_index_of(steps: DataFrame, index: DataFrame) -> DataFrame:
    """``steps`` with ``flat_index`` by an episode index."""
    starts = index.select("episode_id", "ep_start")
    return steps.join(starts, "episode_id").withColumn("flat_index", F.col("ep_start") + F.col("step")).drop("ep_start")


def with_flat_index(steps: DataFrame) -> DataFrame:
    """``steps`` with ``flat_index``, the place of a step in all episodes laid end to end."""
    return flat_index_of(steps, episode_index(steps))


def runs(steps: DataFrame, value: str) -> DataFrame:
    """Runs of equal values inside episodes: ``episode_id, value, run_start, run_len``."""
    order = W.partitionBy("episode_id").orderBy("step")
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(order)) | (F.col("step") == 0)).cast("int")
    islands = steps.withColumn("__run", F.sum(changed).over(order))
    return islands.groupBy("episode_id", "__run", value).agg(F.min("step").alias("run_start"), F.count("*").alias("run_len")).drop("__run")


def last_run_index(rows: DataFrame, episode: str, position: str) -> DataFrame:
    """Episode index of rows in stored order: an id that recurs later is known by its last run.

    A row begins a run if the row before it has another id; rows are compared within ranges of
    positions, and the first of a range with the last of the range before.
    """
    cut = rows.select(F.col(episode).alias("episode_id"), F.col(position).alias("__at"), F.floor(F.col(position) / POSITIONS).alias("__range"))
    ends = cut.groupBy("__range").agg(F.max_by(F.struct("episode_id"), "__at").alias("end"))
    ends = ends.select("__range", F.lag("end").over(W.orderBy("__range")).alias("__end"))
    inside = W.partitionBy("__range").orderBy("__at")
    before = F.coalesce(F.lag(F.struct("episode_id")).over(inside), F.col("__end"))
    begins = cut.join(ends, "__range").withColumn("__new", ~F.struct("episode_id").eqNullSafe(before))
    starts = begins.where("__new").groupBy("episode_id").agg(F.max("__at").alias("ep_start"))
    return cut.join(starts, "episode_id").where("__at >= ep_start").groupBy("episode_id", "ep_start").agg(F.count("*").alias("ep_len"))


def episode_ordinals(steps: DataFrame) -> DataFrame:
    """``episode_id, ordinal``: the place of every episode in order of ids, counted by ranges of ids."""
    ids = with_range(steps.select("episode_id").distinct())
    ranges = ids.groupBy("__range").agg(F.count("*").alias("n"))
    before = ranges.select("__range", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(*_BEFORE)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy("episode_id")) - 1
    return ids.join(before, "__range").select("episode_id", (F.col("__before") + inside).alias("ordinal"))


def explode_episodes(episodes: DataFrame, steps: str = "steps", episode: str = "episode_id") -> DataFrame:
    """Nested episodes as one row per step; an episode without steps gives no row."""
    exploded = episodes.withColumn("ep_len", F.size(steps)).select(
        F.col(episode).alias("episode_id"), "ep_len", F.posexplode(steps).alias("step", "__s")
    )
    return exploded.select("episode_id", "step", "ep_len", "__s.*")


def flat_episode(rows: DataFrame, episode: str) -> DataFrame:
    """Rows without steps as episodes of a single step each."""
    return rows.withColumns({"episode_id": F.col(episode), "step": F.lit(0), "ep_len": F.lit(1)})


def to_transitions(
    steps: DataFrame, observation: list[str] | str, keep_text: bool = True, extras: list[str] | None = None, stretch: int = STRETCH
) -> DataFrame:
    """Steps in the transition layout, with the next step's observation beside the own.

    ``observation`` names the columns that an observation has, or the one column that is it: a struct gives its fields,
    anything else becomes the field ``obs``.

    The last step by position keeps its own observation as the next one, also where the next one
    would be null. ``is_last`` and ``is_terminal`` override the flags by position; reward is 0 and
    action ``[0]`` where a source has none. Of other columns only text is carried, and none of it
    without ``keep_text``. Long episodes are windowed by stretches.
    """
    columns = set(steps.columns)
    order = W.partitionBy("episode_id", "__stretch").orderBy("step")
    at_end = F.col("step") == F.col("ep_len") - 1
    if isinstance(observation, str):
        whole = steps.schema[observation].dataType
        parts = {f.name: (F.col(f"`{observation}`").getField(f.name), f) for f in whole} if isinstance(whole, StructType) else {"obs": (F.col(f"`{observation}`"), steps.schema[observation])}
        observation = [observation]
    else:
        parts = {c: (F.col(c), steps.schema[c]) for c in observation}
    kept = [v.alias(c) for c, (v, f) in parts.items() if keep_text or f.dataType.simpleString() not in ("string", "array<string>")]
    done = F.coalesce("is_last", at_end) if "is_last" in columns else at_end
    flags = with_neighbours(steps, 0, 1, stretch).withColumns({"__obs": F.struct(*kept), "__done": done})
    flags = flags.withColumn("__term", F.coalesce("is_terminal", "__done") if "is_terminal" in columns else F.col("__done"))
    reward = F.coalesce(F.col("reward").cast("float"), F.lit(0.0).cast("float")) if "reward" in columns else F.lit(0.0).cast("float")
    action = F.col("action") if "action" in columns else F.array(F.lit(0.0).cast("float"))
    after = F.when(at_end, F.col("__obs")).otherwise(F.lead("__obs").over(order))
    text = [f.name for f in steps.schema if f.dataType.simpleString() == "string"] if extras is None else extras
    own = {*observation, "episode_id", "step", "ep_len", "is_last", "is_terminal", "reward", "action"}
    return flags.withColumn("__after", after).where("__own").select(
        "episode_id",
        "step",
        "ep_len",
        F.col("__obs").alias("observation"),
        action.alias("action"),
        F.col("__done").alias("done"),
        F.col("__term").alias("terminated"),
        F.struct(F.col("__after").alias("observation"), reward.alias("reward"), F.col("__done").alias("done"), F.col("__term").alias("terminated")).alias("next"),
        *[F.col(c) for c in text if keep_text and c not in own],
    )
