"""Queries on catalogs of real folders, on specs of leaves, and on what a handle samples by default."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.dataset import TrajectoryDataset
from episodica.operators.schema import flattened, leaf_column
from episodica.operators.tubelets import TubeletGrid
from episodica.plans.steps import EVENTS_SQL, event_steps
from episodica.plans.store_queries import fresh
from episodica.sources.catalog import Catalog, list_datasets, listing
from episodica.sources.tables import table

VERSIONS = ("1.0", "1.5", "1.10")
ITEMS = 3
GRID = TubeletGrid(3, 2, 0.2)


def catalog_of_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as datasets by segment and versions by nation, then found again from the listing of their files.

    Every dataset is looked up in its own folder first, resolved to its newest version, and read from there.
    """
    root = fresh(spark, "catalog")
    version = F.element_at(F.array(*[F.lit(v) for v in VERSIONS]), (F.col("c_nationkey") % len(VERSIONS) + 1).cast("int"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("dataset"), version.alias("version"))
    customers.write.partitionBy("dataset", "version").parquet(root)
    known = Catalog.of_root(spark, root)
    listed = list_datasets(known.entries()).withColumn("versions", F.array_join("versions", ","))
    parts = []
    for row in listed.collect():  # one row for each dataset
        found = Catalog.of_root(spark, root)  # without the whole listing
        path = found.path(f"/{row.name}/")
        checks = [found.validate(row.name), found.validate(row.name, path.split("/")[1]), not found.validate(row.name, "version=9")]
        files = listing(spark, f"{root}/{path}", "*.parquet").agg((F.count("*") > 0).alias("has_files"))
        rows = spark.read.parquet(f"{root}/{path}").agg(F.count("*").alias("n_rows"), F.sum("c_custkey").alias("keys"))
        told = [F.lit(row.name).alias("name"), F.lit(row.versions).alias("versions"), F.lit(path).alias("newest"), F.lit(all(checks)).alias("valid")]
        parts.append(rows.crossJoin(files).select(*told, "has_files", "n_rows", "keys"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def spec_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, type and shape of every leaf of image steps, with how many steps have a value there."""
    image = F.struct(F.col("embedding").alias("wrist", metadata={"shape": [4, 4, 4]}), F.col("embedding").alias("flat", metadata={"shape": [64]}), "label")
    steps = table(spark, sf_dir, "embeddings").select(image.alias("observation"), F.col("vec_id").alias("other"), F.lit("go").alias("caption"), F.array(F.col("label").cast("float")).alias("action"))
    specs = TrajectoryDataset(steps).get_modalities()
    counted = steps.agg(*[F.count(leaf_column(s.path)).alias(f"n{k}") for k, s in enumerate(specs)])
    told = [F.struct(F.lit(s.path).alias("path"), F.lit(s.kind).alias("kind"), F.lit(s.dtype).alias("dtype"), F.lit("x".join(map(str, s.shape))).alias("shape"), F.col(f"n{k}").alias("n_values")) for k, s in enumerate(specs)]
    return counted.select(F.explode(F.array(*told)).alias("s")).select("s.*")


def tubelets_of_any_batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tubelets of drawn episodes: a batch size that is asked for changes nothing, the grid alone says what comes."""
    steps = event_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "event_id")
    data = TrajectoryDataset(steps).with_sampler(GRID)
    return reduce(DataFrame.unionByName, [data.sample(n, seed=n % 2).select(F.lit(n).alias("asked"), "episode_id", "clip", "t", "step", "event_id") for n in (1, 2, 64, 65)])


def default_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of 32 that a handle draws when nothing is said: every leaf at its anchor alone, and the same one next."""
    batch = TrajectoryDataset(event_steps(spark, sf_dir).select("episode_id", "step", "ep_len", "event_id", "value", "event_type")).sample()
    one = lambda c: F.get(F.col(f"`{c}`"), F.lit(0))
    return batch.select("b", "episode_id", "anchor_step", one("event_id").alias("event_id"), one("value").alias("value"), one("next/value").alias("next_value"), F.size("value").alias("frames"), "event_type")


def listed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' first three turns as a list of nested values: a column for every place and field."""
    turn = F.struct("turn", F.struct("role", F.length("text").alias("size")).alias("said"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    nested = turns.select("conv_id", F.slice("all", 1, ITEMS).alias("turns", metadata={"items": ITEMS}))
    return flattened(nested).toDF("conv_id", *[f"{n}{k}" for k in range(ITEMS) for n in ("turn", "role", "size")]).na.fill(-1).na.fill("")


QUERIES = {f.__name__: f for f in (catalog_of_folders, spec_values, tubelets_of_any_batch_size, default_sample, listed_leaves)}
_SPECS = (
    ("observation/wrist", "image", "float", "4x4x4"), ("observation/flat", "state", "float", "64"), ("observation/label", "state", "int", ""),
    ("other", "generic", "bigint", ""), ("caption", "text", "string", ""), ("action", "action", "float", ""),
)
ORACLE_SQL = {
    "listed_leaves": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) SELECT conv_id, "
    + ", ".join(f"coalesce(max(turn) FILTER (k = {k}), -1) AS turn{k}, coalesce(max(role) FILTER (k = {k}), '') AS role{k}, coalesce(max(length(text)) FILTER (k = {k}), -1) AS size{k}" for k in range(ITEMS))
    + " FROM n GROUP BY conv_id",
    "catalog_of_folders": f"""WITH c AS (SELECT 'dataset=' || lower(c_mktsegment) AS name, c_nationkey % {len(VERSIONS)} AS k, c_custkey FROM customer),
v AS (SELECT name, string_agg(DISTINCT 'version=' || {list(VERSIONS)}[k + 1], ',' ORDER BY 'version=' || {list(VERSIONS)}[k + 1]) AS any_order, max(k) AS top, list_reverse(list_sort(list(DISTINCT k))) AS ks FROM c GROUP BY name)
SELECT v.name, array_to_string(list_transform(ks, lambda k: 'version=' || {list(VERSIONS)}[k + 1]), ',') AS versions, v.name || '/version=' || {list(VERSIONS)}[top + 1] AS newest,
       true AS valid, true AS has_files, count(*) AS n_rows, sum(c_custkey)::BIGINT AS keys
FROM v JOIN c ON c.name = v.name AND c.k = v.top GROUP BY v.name, ks, top""",
    "spec_values": f"SELECT path, kind, dtype, shape, n AS n_values FROM (VALUES {', '.join(map(str, _SPECS))}) s(path, kind, dtype, shape), (SELECT count(*) AS n FROM embeddings)",
    "tubelets_of_any_batch_size": f"""WITH {EVENTS_SQL}, e AS (SELECT DISTINCT episode_id, ep_len FROM ev),
p AS (SELECT asked, arg_min(episode_id, md5((asked % 2)::VARCHAR || ':' || episode_id::VARCHAR)) AS episode_id FROM e, (SELECT unnest([1, 2, 64, 65]) AS asked) GROUP BY asked),
g AS (SELECT asked, episode_id, ep_len, clip, t, greatest(0, ep_len - 1 - {(GRID.frames - 1) * GRID.stride}) AS last
      FROM p JOIN e USING (episode_id), (SELECT unnest(range({GRID.clips})) AS clip), (SELECT unnest(range({GRID.frames})) AS t))
SELECT asked, episode_id, clip, t, step, event_id
FROM (SELECT *, least(ep_len - 1, round_even(clip * last / {GRID.clips - 1}, 0)::INT + t * {GRID.stride})::INT AS step FROM g) JOIN ev USING (episode_id, step)""",
    "default_sample": f"""WITH {EVENTS_SQL}, fl AS (SELECT *, row_number() OVER (ORDER BY episode_id, step) - 1 AS flat FROM ev)
SELECT b, episode_id, step AS anchor_step, event_id, value, value AS next_value, 1 AS frames, event_type
FROM (SELECT b, cast(concat('0x', substr(md5(concat('0:', b::VARCHAR)), 1, 15)) AS BIGINT) % (SELECT count(*) FROM ev) AS flat FROM (SELECT unnest(range(32)) AS b)) JOIN fl USING (flat)""",
}
