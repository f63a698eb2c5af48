"""Windows of steps around anchors, clamped to their episode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.operators.episodes import STRETCH, with_neighbours

#: A batch of at most so many gathered steps is broadcast to the steps; a larger one is shuffled.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class TemporalWindow:
    """Time offsets in seconds by leaf, compiled to step offsets; order and repeats are kept.

    The next window of a leaf mirrors its window: the negated offsets in ascending order.
    """

    delta_timestamps: dict[str, list[float]]
    control_frequency: float = 10.0

    def offsets(self, leaf: str) -> list[int]:
        """Step offsets, halves rounded to even."""
        return [round(dt * self.control_frequency) for dt in self.delta_timestamps[leaf]]

    def next_offsets(self, leaf: str) -> list[int]:
        """Step offsets of the mirrored window."""
        return sorted(-k for k in self.offsets(leaf))


def at_offset(value: Column, k: int) -> Column:
    """The value ``k`` steps on in rows of ``with_neighbours``, held at the ends of the episode; nulls are values like others."""
    order = W.partitionBy("episode_id", "__stretch").orderBy("step")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if k == 0:
        return value
    if k < 0:
        return F.when(F.col("step") + k < 0, F.first(value).over(whole)).otherwise(F.lag(value, -k).over(order))
    return F.when(F.col("step") + k >= F.col("ep_len"), F.last(value).over(whole)).otherwise(F.lead(value, k).over(order))


def _arrays(steps: DataFrame, arrays: dict[str, tuple[str, list[int]]], stretch: int) -> DataFrame:
    """Own rows with ``__window``, a struct of the arrays ``name: (leaf, offsets)``."""
    reach = [k for _, offsets in arrays.values() for k in offsets] or [0]
    dealt = with_neighbours(steps, max(0, -min(reach)), max(0, max(reach)), stretch)
    made = [F.array(*[at_offset(F.col(leaf), k) for k in offsets]).alias(name) for name, (leaf, offsets) in arrays.items()]
    return dealt.withColumn("__window", F.struct(*made)).where("__own")


def dense_windows(steps: DataFrame, leaves: dict[str, list[int]], keep: tuple[str, ...] = (), stretch: int = STRETCH) -> DataFrame:
    """A window of every leaf around every step, as arrays: one exchange and one sort for all, long episodes by stretches."""
    made = _arrays(steps, {name: (name, offsets) for name, offsets in leaves.items()}, stretch)
    return made.select("episode_id", "step", *keep, *[F.col("__window").getField(name).alias(name) for name in leaves])


def long_windows(
    steps: DataFrame, outputs: dict[str, tuple[str, list[int]]], keep: tuple[str, ...] = (), stretch: int = STRETCH
) -> DataFrame:
    """Windows of equal length in long form: ``episode_id, step, t`` and a column per output.

    ``outputs`` maps an output column to its leaf and offsets.
    """
    made = _arrays(steps, outputs, stretch)
    zipped = made.select("episode_id", "step", *keep, F.arrays_zip(*[F.col("__window").getField(n).alias(n) for n in outputs]).alias("z"))
    return zipped.select("episode_id", "step", *keep, F.posexplode("z").alias("t", "w")).select(
        "episode_id", "step", *keep, "t", *[F.col(f"w.{k}").alias(n) for k, n in zip(_zip_names(zipped), outputs, strict=True)]
    )


def _zip_names(zipped: DataFrame) -> list[str]:
    return [f.name for f in zipped.schema["z"].dataType.elementType]


def gather(steps: DataFrame, anchors: DataFrame, offsets: list[int], leaves: list[str], rows: int | None = None) -> DataFrame:
    """Leaves at clamped offsets from anchors ``(anchor columns, episode_id, anchor_step, ep_len)``.

    An equi-join on episode and step, linear for leaves of any size. Anchors are broadcast when
    ``rows``, their number, keeps the gathered steps below ``BROADCAST_ROWS``.
    """
    dealt = anchors.withColumn("__o", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in enumerate(offsets)])))
    source = F.greatest(F.lit(0), F.least(F.col("ep_len") - 1, F.col("anchor_step") + F.col("__o.k")))
    wanted = dealt.withColumns({"t": F.col("__o.t"), "step": source.cast("int")}).drop("__o", "ep_len")
    if rows is not None and rows * len(offsets) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return steps.select("episode_id", "step", *leaves).join(wanted, ["episode_id", "step"])


def batch_windows(steps: DataFrame, anchors: DataFrame, window: TemporalWindow, rows: int | None = None) -> DataFrame:
    """One row per anchor ``b``: an array per windowed leaf and, as ``next/<leaf>``, its mirrored one.

    Leaves without a window keep their value at the anchor. One join gathers the steps of all
    windows, each leaf only at the offsets that its windows have.
    """
    windowed = list(window.delta_timestamps)
    plain = [c for c in steps.columns if c not in (*windowed, "episode_id", "step", "ep_len")]
    wanted = {leaf: {*window.offsets(leaf), *window.next_offsets(leaf)} for leaf in windowed} | {leaf: {0} for leaf in plain}
    offsets = sorted({0}.union(*wanted.values()))
    place = {k: t for t, k in enumerate(offsets)}

    def values(leaf: str) -> Column:
        at = F.col("t").isin([place[k] for k in wanted[leaf]])
        return F.map_from_entries(F.collect_list(F.when(at, F.struct("t", F.col(f"`{leaf}`"))))).alias(f"__{leaf}")

    found = gather(steps, anchors, offsets, [*windowed, *plain], rows)
    by_anchor = found.groupBy("b", "episode_id", "anchor_step").agg(*[values(leaf) for leaf in (*windowed, *plain)])
    pick = lambda leaf, ks: F.array(*[F.col(f"`__{leaf}`")[place[k]] for k in ks])
    arrays = [
        x for leaf in windowed for x in (pick(leaf, window.offsets(leaf)).alias(leaf), pick(leaf, window.next_offsets(leaf)).alias(f"next/{leaf}"))
    ]
    return by_anchor.select("b", "episode_id", "anchor_step", *[F.col(f"`__{leaf}`")[place[0]].alias(leaf) for leaf in plain], *arrays)


def default_window(leaves: list[str], given: dict[str, list[float]], frequency: float = 10.0) -> TemporalWindow:
    """The anchor alone for every leaf, with the caller's windows on top."""
    return TemporalWindow({**{leaf: [0.0] for leaf in leaves}, **given}, frequency)
