"""What several operators of this subpackage need: folders all executors see, and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words, for java.util.regex.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_REGEX = rf"[^{SPACE_CLASS}]+"


#: Folders of ``scratch`` blocks that are open, the innermost last.
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (as in tests) may name none, and is given a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="episodica-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A path in the shared folder, in the open ``scratch`` block's, that nothing else uses."""
    return f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of the block are deleted at its end; what is to stay is written to a path from outside."""
    path = fresh_path(spark, "scratch")
    _SCRATCH.append(path)
    try:
        yield
    finally:
        _SCRATCH.pop()
        remove(spark, path)


def written(df: DataFrame, stem: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_small(df: DataFrame, stem: str) -> DataFrame:
    """``written`` for tables of one narrow row per key, in fewer files than there are shuffle partitions.

    A join with the plain table, not with the aggregate itself, lets Spark split its hot keys.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.coalesce(max(1, n // 8)), stem)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of whole texts that Spark hands to Python at once.
ARROW_ROWS = 250


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session set to pass at most ``ARROW_ROWS`` rows to Python at once.

    The default of 10,000 whole texts is held several times over, by the executor and its workers.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows)) <= ARROW_ROWS:
        df.sparkSession.conf.set(rows, str(ARROW_ROWS))
    return df


def words(text: Column) -> Column:
    """Words of a text by ``WORD_REGEX``; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"[{SPACE_CLASS}]+")
    return F.filter(parts, lambda w: w != "")


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row.

    Catalyst may merge a plain projection into the lambdas that use it, which would then compute it
    for every element; a generator of one row is not merged.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def free_name(columns: list[str], stem: str) -> str:
    """A name for a working column that is none of ``columns``, whatever their case."""
    taken, name = {c.lower() for c in columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's values and of which of them are null."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, __row, __kept``: a hash of the whole row, and its columns in a struct, where their names clash with none."""
    return docs.select("doc_id", row_key(docs).alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__kept"))


def row_place(row: Column) -> Column:
    """The order of rows by document id, nulls last, then by ``row``."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), row.alias("row"))


#: Columns that name a row in joins: is its id null, its id as text, and its hash.
ROW_NAME = ("__no_id", "__id", "__row")


def row_name(no_id: Column, doc_id: Column, row: Column) -> dict[str, Column]:
    """The values of ``ROW_NAME``, none of them null."""
    return dict(zip(ROW_NAME, (no_id, F.coalesce(doc_id.cast("string"), F.lit("")), row), strict=True))


def rows_at(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """One row of ``keyed``, which has a ``__row``, for every ``place`` of ``places``.

    The join's columns are those by which repeated rows are dropped, so rows are exchanged once.
    """
    wanted = places.select(*[c.alias(name) for name, c in row_name(F.col("place.no_id"), F.col("place.id"), F.col("place.row")).items()])
    named = keyed.withColumns(row_name(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row")))
    return named.join(wanted, [*ROW_NAME], "left_semi").dropDuplicates([*ROW_NAME]).select(*keyed.columns)


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")
