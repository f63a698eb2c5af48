"""Catalog of datasets and their versions from a listing of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from episodica.functions.names import strip_slashes, version_key


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path`` of all files under a root, relative to it; only the listing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    start = _quoted(root.split("://")[-1].rstrip("/"))
    return found.select(F.regexp_replace("path", f"^.*?{start}/", "").alias("path"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def catalog(paths: DataFrame) -> DataFrame:
    """``name, version, path``: the first two parts of every path, version '' where there is one part."""
    parts = F.split(strip_slashes(F.regexp_replace("path", "^[a-z]+://", "")), "/+")
    named = paths.select(parts.alias("p")).select(F.get("p", F.lit(0)).alias("name"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("version"))
    return named.where("name <> ''").distinct().withColumn("path", F.when(F.col("version") == "", F.col("name")).otherwise(F.concat_ws("/", "name", "version")))


def list_datasets(entries: DataFrame) -> DataFrame:
    """``name, versions``: versions newest first."""
    keyed = F.sort_array(F.collect_list(F.struct(version_key(F.col("version")).alias("k"), F.col("version").alias("v"))), asc=False)
    return entries.groupBy("name").agg(F.transform(keyed, lambda x: x["v"]).alias("versions"))


def latest(entries: DataFrame) -> DataFrame:
    """``name, version, path`` of every dataset's newest version."""
    newest = F.max_by(F.struct("version", "path"), F.struct(version_key(F.col("version")), F.col("version")))
    return entries.groupBy("name").agg(newest.alias("x")).select("name", "x.version", "x.path")


class Catalog:
    """A catalog that is read once and again on ``refresh``.

    ``read`` gives all paths; ``read_one``, if given, those of one dataset, so that it is found
    without the whole listing.
    """

    def __init__(self, read, read_one=None):
        self._read, self._read_one, self._entries = read, read_one, None

    @classmethod
    def of_root(cls, spark: SparkSession, root: str) -> Catalog:
        """The datasets under a root; one is looked up in its own folder."""

        def one(name: str) -> DataFrame:
            try:
                found = listing(spark, f"{root.rstrip('/')}/{name}")
            except AnalysisException:  # no such folder
                return spark.createDataFrame([], "path string")
            return found.select(F.concat(F.lit(f"{name}/"), "path").alias("path"))

        return cls(lambda: listing(spark, root), one)

    def _of(self, name: str) -> DataFrame:
        """Entries of a name: looked up directly unless the whole catalog is at hand."""
        if self._entries is None and self._read_one is not None:
            return catalog(self._read_one(name)).where(F.col("name") == name)
        return self.entries().where(F.col("name") == name)

    def entries(self, refresh: bool = False) -> DataFrame:
        """All entries, cached."""
        if self._entries is None or refresh:
            if self._entries is not None:
                self._entries.unpersist()
            self._entries = catalog(self._read()).cache()
        return self._entries

    def validate(self, name: str, version: str | None = None) -> bool:
        """Is there such a dataset, or such a version of it?"""
        found = self._of(name.strip("/"))
        return not (found if version is None else found.where(F.col("version") == version)).isEmpty()

    def path(self, name: str, version: str | None = None) -> str:
        """Path of a version, the newest by default; a ``ValueError`` names what there is."""
        found = self._of(name.strip("/"))
        row = (latest(found) if version is None else found.where(F.col("version") == version)).first()
        if row is None:
            near = [r.version if version else r.name for r in (found if version else self.entries()).limit(20).collect()]
            raise ValueError(f"no dataset {name} {version or ''}; there are {', '.join(sorted(set(near)))}")
        return row.path
