"""Episodes materialised as Parquet, with a log of snapshots that names what counts."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from episodica.operators.episodes import flat_index_of, index_of
from episodica.operators.selection import select_episodes
from episodica.sources import files

MANIFEST = "episode_id bigint, n_steps bigint, expected bigint, first_step int, last_step int, file string, batch string, began bigint"
#: Up to so many places are looked up by their own ranges, more by all ids and the least and greatest step.
EXACT_PLACES = 200


@dataclass(frozen=True)
class Part:
    """A folder of steps and its manifest: how many merges made it, and in which version it came."""

    name: str
    level: int
    version: int


@dataclass(frozen=True)
class Snapshot:
    """What counts at a version: parts, and all columns that a step has had so far."""

    version: int = 0
    parts: tuple[Part, ...] = ()
    schema: StructType | None = None

    def text(self) -> str:
        """As JSON."""
        return json.dumps({"version": self.version, "parts": [[p.name, p.level, p.version] for p in self.parts], "schema": self.schema and self.schema.jsonValue()})

    @classmethod
    def of(cls, text: str) -> Snapshot:
        """From JSON."""
        told = json.loads(text)
        return cls(told["version"], tuple(Part(*p) for p in told["parts"]), told["schema"] and StructType.fromJson(told["schema"]))


def united(old: StructType | None, new: StructType) -> StructType:
    """Columns of both, those of ``new`` behind; a ``ValueError`` where one column has two types."""
    if old is None:
        return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in new])
    known = {f.name.lower(): f for f in old}
    for f in new:
        same = known.get(f.name.lower())
        if same is not None and (same.name != f.name or same.dataType != f.dataType):
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, stored is {same.name} {same.dataType.simpleString()}")
    return StructType([*old, *[StructField(f.name, f.dataType, True, f.metadata) for f in new if f.name.lower() not in known]])


class EpisodeStore:
    """Steps under ``{root}/data``, a manifest of each part under ``{root}/manifest``, snapshots under ``{root}/log``.

    A write adds a part, a folder of files sorted by episode and step, then its manifest: a row for every episode in
    every file, with the range of its steps. It counts once the log has a snapshot that names it, so an interrupted
    write leaves a folder that nobody reads and ``vacuum`` removes. A log entry is a file that can be made once: the
    second of two writers fails and adds nothing. Of ``fan_in`` parts of one level, each about as large as the others,
    one part of the next level is made, so a store of n writes has some ``fan_in * log(n)`` parts.

    An episode is whole when as many steps are stored as its ``ep_len`` says; without that column, when any are.
    Steps may have any further columns; later writes may bring new ones, which earlier steps have as nulls.
    """

    def __init__(self, spark: SparkSession, root: str, fan_in: int = 8, version: int | None = None):
        self.spark, self.root, self.fan_in, self.version = spark, root.rstrip("/"), fan_in, version

    def at(self, version: int) -> EpisodeStore:
        """The store as it was at a version, for reading."""
        return EpisodeStore(self.spark, self.root, self.fan_in, version)

    def versions(self) -> list[int]:
        """Versions that the log still has."""
        return [int(n.removesuffix(".json")) for n in files.names_in(self.spark, f"{self.root}/log") if n.endswith(".json") and n[:-5].isdigit()]

    def snapshot(self) -> Snapshot:
        """The last snapshot, or that of the version asked for."""
        known = self.versions()
        if self.version is not None and self.version not in known:
            raise ValueError(f"no version {self.version} in {known}")
        if not known:
            return Snapshot()
        return Snapshot.of(files.read_text(self.spark, self._entry(max(known) if self.version is None else self.version)))

    def _entry(self, version: int) -> str:
        return f"{self.root}/log/{version:010d}.json"

    def _data(self, part: str) -> str:
        return f"{self.root}/data/{part}"

    def fragments(self) -> DataFrame:
        """``episode_id, n_steps, expected, first_step, last_step, file, batch, began``: what each file has of each episode."""
        return self._fragments(self.snapshot().parts)

    def _fragments(self, parts: tuple[Part, ...]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/manifest/{p.name}" for p in parts])

    def manifest(self) -> DataFrame:
        """``episode_id, n_steps, expected, batch`` of stored episodes, with the batch that began them."""
        return self.fragments().groupBy("episode_id").agg(F.sum("n_steps").alias("n_steps"), F.max("expected").alias("expected"), F.min_by("batch", "began").alias("batch"))

    def _whole(self, certain: bool) -> DataFrame:
        """Ids of whole episodes; ``certain`` leaves out those of unknown length."""
        enough = F.col("n_steps") >= F.col("expected")
        return self.manifest().where(enough if certain else enough | F.col("expected").isNull()).select("episode_id")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Wanted episodes that are not stored whole."""
        return wanted.select("episode_id").distinct().join(self._whole(False), "episode_id", "left_anti")

    def is_stored(self, wanted: DataFrame) -> bool:
        """Are all wanted episodes stored whole?"""
        return self.missing(wanted).isEmpty()

    def build(self, steps: DataFrame, wanted: DataFrame, batch: str) -> None:
        """Store the steps that wanted episodes lack; ``batch`` names this write."""
        lacking = wanted.select("episode_id").distinct().join(self._whole(True), "episode_id", "left_anti")
        self.append(select_episodes(steps, lacking), batch)

    def append(self, steps: DataFrame, batch: str) -> None:
        """Store the steps that are missing, each once, also of episodes that are stored in part.

        Only steps decide what is missing, not the batch's name: another stream, or one that begins
        anew, may use a name again.
        """
        before = self.snapshot()
        fresh = steps.dropDuplicates(["episode_id", "step"])
        if before.parts:
            known = self._read(before, self._files(before, steps.select("episode_id").distinct()), ("episode_id", "step"))
            fresh = fresh.join(known, ["episode_id", "step"], "left_anti")
        self._add(fresh, batch, before)

    def _add(self, fresh: DataFrame, batch: str, before: Snapshot) -> None:
        united(before.schema, fresh.schema)  # before anything is written
        self._name(self._write(fresh, before.version + 1, 0), batch, fresh)
        self._merge_full_levels()

    def _name(self, part: Part, batch: str, fresh: DataFrame) -> None:
        """Make a part that was written count; one without steps goes."""
        before = self.snapshot()
        told = self._told(part, fresh.schema).withColumns({"batch": F.lit(batch), "began": F.lit(part.version).cast("long")})
        told.write.parquet(f"{self.root}/manifest/{part.name}")
        if self._fragments((part,)).isEmpty():
            self._drop(part)
            return
        self._commit(Snapshot(part.version, (*before.parts, part), united(before.schema, fresh.schema)))

    def _write(self, steps: DataFrame, version: int, level: int) -> Part:
        """A new part. Small writes make few files, and an episode that is too large for one is split."""
        part = Part(f"{version:010d}-{uuid.uuid4().hex}", level, version)
        steps.hint("rebalance", "episode_id").sortWithinPartitions("episode_id", "step").write.parquet(self._data(part.name))
        return part

    def _told(self, part: Part, schema: StructType) -> DataFrame:
        """What a part's files hold, read from their columns of ids and steps alone."""
        own = self.spark.read.schema(schema).parquet(self._data(part.name))
        expected = F.max(F.col("ep_len").cast("long")) if "ep_len" in own.columns else F.lit(None).cast("long")
        step = F.col("step").cast("int")
        counted = own.groupBy(F.col("episode_id").cast("long").alias("episode_id"), F.col("_metadata.file_name").alias("name"))
        told = counted.agg(F.count("*").alias("n_steps"), expected.alias("expected"), F.min(step).alias("first_step"), F.max(step).alias("last_step"))
        return told.select("episode_id", "n_steps", "expected", "first_step", "last_step", F.concat(F.lit(f"{part.name}/"), "name").alias("file"))

    def _commit(self, after: Snapshot) -> None:
        try:
            files.write_new_text(self.spark, self._entry(after.version), after.text())
        except FileExistsError as e:
            raise RuntimeError(f"another write made version {after.version} of {self.root}") from e

    def _drop(self, part: Part) -> None:
        for path in (self._data(part.name), f"{self.root}/manifest/{part.name}"):
            files.delete(self.spark, path)

    def _merge_full_levels(self) -> None:
        """Merge parts level by level while one has ``fan_in`` of them."""
        level = 0
        while level <= max((p.level for p in self.snapshot().parts), default=-1):
            own = [p for p in self.snapshot().parts if p.level == level]
            if len(own) >= self.fan_in:
                self._merge(own, level + 1)
            level += 1

    def compact(self) -> None:
        """One part of all; files are sized anew."""
        parts = list(self.snapshot().parts)
        if len(parts) > 1:
            self._merge(parts, max(p.level for p in parts) + 1)

    def _merge(self, parts: list[Part], level: int) -> None:
        before = self.snapshot()
        version = before.version + 1
        steps = self.spark.read.schema(before.schema).parquet(*[self._data(p.name) for p in parts])
        part = self._write(steps, version, level)
        began = self._fragments(tuple(parts)).groupBy("episode_id").agg(F.min_by("batch", "began").alias("batch"), F.min("began").alias("began"))
        self._told(part, before.schema).join(began, "episode_id").select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{self.root}/manifest/{part.name}")
        kept = tuple(p for p in before.parts if p not in parts)
        self._commit(replace(before, version=version, parts=(part, *kept)))

    def vacuum(self, keep: int = 1, least_age: float = 3600.0) -> int:
        """Remove folders that no kept snapshot names; how many of them held steps.

        Kept are the last ``keep`` snapshots, and all that is younger than ``least_age`` seconds: a folder that no
        snapshot names may be a write under way.
        """
        old = lambda path: files.age_of(self.spark, path) >= least_age
        known = self.versions()
        gone = [v for v in known[:-keep] if old(self._entry(v))]
        live = {p.name for v in known if v not in gone for p in self.at(v).snapshot().parts}
        for version in gone:
            files.delete(self.spark, self._entry(version))
        paths = [(f, f"{self.root}/{f}/{n}") for f in ("data", "manifest") for n in files.names_in(self.spark, f"{self.root}/{f}") if n not in live]
        dropped = [(f, path) for f, path in paths if old(path)]
        for _, path in dropped:
            files.delete(self.spark, path)
        return [f for f, _ in dropped].count("data")

    def _files(self, at: Snapshot, wanted: DataFrame) -> list[str]:
        """Files that hold any of the wanted episodes; as many names as there are files, as in any listing."""
        found = select_episodes(self._fragments(at.parts), wanted).select("file").distinct()
        return sorted(r.file for r in found.collect())

    def _read(self, at: Snapshot, names: list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
        if not names:
            empty = self.spark.createDataFrame([], at.schema)
            return empty if columns is None else empty.select(*columns)
        read = self.spark.read.schema(at.schema).parquet(*[f"{self.root}/data/{n}" for n in names])
        return read if columns is None else read.select(*columns)

    def stored(self, wanted: DataFrame | None = None) -> DataFrame:
        """Stored steps of the wanted episodes or all; only files that hold them are opened."""
        at = self.snapshot()
        if wanted is None:
            return self._read(at, [p.name for p in at.parts])
        return select_episodes(self._read(at, self._files(at, wanted)), wanted)

    def steps_at(self, places: list[tuple[int, int, int]]) -> DataFrame:
        """Stored steps that lie in any of some ``(episode_id, first step, last step)``, perhaps with others of their episodes.

        For a bounded list, such as a batch's draws: the manifest gives the files that hold them, and ids and steps are
        pushed to those files, whose rows are sorted by them.
        """
        at = self.snapshot()
        if not places:
            return self._read(at, [])
        asked = self.spark.createDataFrame(places, "episode_id bigint, low int, high int")
        overlap = (F.col("first_step") <= F.col("high")) & (F.col("last_step") >= F.col("low"))
        ids = sorted({p[0] for p in places})
        known = self._fragments(at.parts).where(F.col("episode_id").isin(ids))
        names = sorted(r.file for r in known.join(F.broadcast(asked), "episode_id").where(overlap).select("file").distinct().collect())
        if len(places) <= EXACT_PLACES:
            inside = reduce(or_, ((F.col("episode_id") == e) & F.col("step").between(low, high) for e, low, high in set(places)))
        else:
            inside = F.col("episode_id").isin(ids) & F.col("step").between(min(p[1] for p in places), max(p[2] for p in places))
        return self._read(at, names).where(inside)

    def index(self, wanted: DataFrame | None = None) -> DataFrame:
        """``episode_id, ep_start, ep_len`` from the manifest alone."""
        known = self.manifest().select("episode_id", F.col("n_steps").alias("ep_len"))
        return index_of(known if wanted is None else select_episodes(known, wanted))

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """Stored steps, of the wanted episodes or all, with their flat index."""
        if not self.snapshot().parts or (wanted is not None and wanted.isEmpty()):
            raise ValueError("no episodes are selected or stored")
        lost = None if wanted is None else self.missing(wanted)
        if lost is not None and not lost.isEmpty():
            raise ValueError(f"{lost.count()} of the episodes are not stored")
        return flat_index_of(self.stored(wanted).drop("flat_index"), self.index(wanted))

    def describe(self, description: str = "", splits: DataFrame | None = None) -> None:
        """Keep a description, and the split of every episode of ``splits`` (``episode_id, split``, an episode once)."""
        known = [int(n[:-5]) for n in files.names_in(self.spark, f"{self.root}/info") if n.endswith(".json") and n[:-5].isdigit()]
        told = {"description": description, "splits": {}, "members": None}
        if splits is not None:
            told["members"] = f"splits/{uuid.uuid4().hex}"
            splits.select("episode_id", "split").write.parquet(f"{self.root}/{told['members']}")
            kept = self.spark.read.parquet(f"{self.root}/{told['members']}")
            if not kept.groupBy("episode_id").count().where("count > 1").isEmpty():
                files.delete(self.spark, f"{self.root}/{told['members']}")
                raise ValueError("an episode is in more than one split")
            told["splits"] = {r.split: r["count"] for r in kept.groupBy("split").count().orderBy("split").collect()}  # a row for each split
        files.write_new_text(self.spark, f"{self.root}/info/{max(known, default=0) + 1:010d}.json", json.dumps(told))

    def info(self) -> dict:
        """The last description, and the number of episodes of each split."""
        known = [n for n in files.names_in(self.spark, f"{self.root}/info") if n.endswith(".json") and n[:-5].isdigit()]
        return json.loads(files.read_text(self.spark, f"{self.root}/info/{known[-1]}")) if known else {"description": "", "splits": {}, "members": None}

    def split(self, name: str) -> DataFrame:
        """``episode_id`` of the episodes of a split; a ``ValueError`` names the splits that there are."""
        told = self.info()
        if name not in told["splits"]:
            raise ValueError(f"no split {name}, there are {', '.join(told['splits']) or 'none'}")
        return self.spark.read.parquet(f"{self.root}/{told['members']}").where(F.col("split") == name).select("episode_id")

    def delete(self) -> None:
        """Remove the store with all it holds."""
        files.delete(self.spark, self.root)
