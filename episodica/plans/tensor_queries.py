"""Queries on tensors, rendering geometry, modalities, versions and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions import names, tensors
from episodica.functions.render import channel_ranges, normalised
from episodica.operators.episodes import number_steps
from episodica.sources import catalog
from episodica.sources.tables import table

HEIGHT, WIDTH, CHANNELS = 4, 4, 4

#: Paths that the queries on names are asked about.
PATHS = (
    "observation/image", "observation/depth", "observation/keyframe", "language_instruction", "context", "observation/gripper_velocity",
    "action", "observation/ee_pos", "wheel", "next/reward", "done", "Camera_Left", "policy_logits", "free_space", "timestamp",
)


def _values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({columns})")


def hwc_to_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a 4 x 4 x 4 image, channels first."""
    vectors = table(spark, sf_dir, "embeddings")
    flat = tensors.hwc_to_chw(F.col("embedding"), HEIGHT, WIDTH, CHANNELS)
    return vectors.select("vec_id", F.posexplode(flat).alias("k", "value")).withColumn("value", F.col("value").cast("double"))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "value"))
    return long.select("vec_id", "k", (F.col("k") % CHANNELS).alias("channel"), F.col("value").cast("double").alias("value"))


def percentile_range_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last percentile of every channel, linear between values, to nine places."""
    return channel_ranges(_channels(spark, sf_dir)).select("channel", *[F.round(c, 9).alias(c) for c in ("lo", "hi")])


def normalize_uint8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every value within its channel's range."""
    return normalised(_channels(spark, sf_dir)).select("vec_id", "k", F.col("code").cast("bigint").alias("code"))


def normalize_uint8_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with event types as channels."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("channel"), "value")
    return normalised(events).select("event_id", F.col("code").cast("bigint").alias("code"))


def layout_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of clips by their shapes, made of the numbers of every part."""
    axis = lambda n: (F.floor(F.col("p_partkey") / n) % 5 + 1).cast("int")
    five, four = F.array(F.col("p_size"), axis(1), axis(5), axis(25), axis(125)), F.array(F.col("p_size"), axis(1), axis(5), axis(25))
    shapes = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, five).otherwise(four).alias("shape"))
    layout = F.when(F.size("shape") == 5, tensors.layout_5d(F.col("shape"))).otherwise(tensors.layout_4d(F.col("shape")))
    return shapes.select("p_partkey", F.coalesce(layout, F.lit("none")).alias("layout"))


def mosaic_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every nation's customers in a mosaic of them."""
    customers = number_steps(table(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"])
    place = tensors.mosaic_place(F.col("step").cast("bigint"), F.col("ep_len").cast("bigint"), F.lit(48), F.lit(64))
    return customers.select("c_custkey", place.alias("p")).select("c_custkey", "p.*")


def strip_pad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left edges and bottom padding of label groups laid side by side, as high as their size."""
    from pyspark.sql import Window as W

    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("height"))
    width = F.col("label") + 10
    before = F.coalesce(F.sum(width).over(W.orderBy("label").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = sizes.agg(F.max("height").alias("top"))
    return sizes.withColumn("x0", before).crossJoin(F.broadcast(top)).select("label", "x0", "height", (F.col("top") - F.col("height")).alias("pad_bottom"))


def kind_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of fixed paths, and of the words of page addresses."""
    fixed = _values(spark, ", ".join(f"('{p}')" for p in PATHS), "path")
    words = table(spark, sf_dir, "pages").select(F.explode(F.split("url", "[/.?=&#]+")).alias("path")).where("path <> ''").distinct()
    return fixed.unionByName(words).select("path", names.kind_of(F.col("path")).alias("kind"))


def modalities_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted paths by kind, of the paths and words of ``kind_inference``."""
    paths = kind_inference(spark, sf_dir).distinct()
    return paths.where(F.col("kind") != "generic").groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat_ws(".", F.lit("v1"), (F.col("p_size") % 12).cast("string"), F.concat((F.col("p_partkey") % 11).cast("string"), F.lit("-beta")))
    paths = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", version, F.lit("data.bin")).alias("path"))
    return catalog.catalog(paths)


def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version of every dataset."""
    return catalog.latest(_versions(spark, sf_dir))


def versions_sorted_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, newest first."""
    return catalog.list_datasets(_versions(spark, sf_dir)).select("name", F.array_join("versions", ",").alias("versions"))


def catalog_from_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as a listing: hosts as datasets, first parts as versions."""
    found = catalog.catalog(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))
    return found.groupBy("name").agg(F.count("*").alias("n_versions"), F.max("version").alias("last_version"))


QUERIES = {
    f.__name__: f
    for f in (
        hwc_to_chw,
        percentile_range_per_channel,
        normalize_uint8,
        normalize_uint8_events,
        layout_detect,
        mosaic_geometry,
        strip_pad_geometry,
        kind_inference,
        modalities_grouped,
        version_latest,
        versions_sorted_desc,
        catalog_from_listing,
    )
}

_KIND = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(words)}') THEN '{kind}'" for kind, words in names.KIND_WORDS)
    + " ELSE 'generic' END"
)
_PATHS = "(VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ") v(path)"
_VERSIONS = """(SELECT *, name || '/' || version AS path, list_transform(regexp_extract_all(version, '[0-9]+'), lambda x: x::BIGINT) AS key
  FROM (SELECT DISTINCT p_brand AS name, 'v1.' || p_size % 12 || '.' || p_partkey % 11 || '-beta' AS version FROM part))"""
_CHANNEL = f"""c AS (SELECT vec_id, k::INT AS k, (k % {CHANNELS})::INT AS channel, embedding[k + 1]::DOUBLE AS value
  FROM embeddings, (SELECT unnest(range({HEIGHT * WIDTH * CHANNELS})) AS k))"""
_CODE = "floor(greatest(0.0, least(1.0, (value - lo) / greatest(hi - lo, 1e-6::DOUBLE))) * 255)::BIGINT AS code"
_WORDS = f"""(SELECT path FROM {_PATHS} UNION ALL
  SELECT DISTINCT path FROM (SELECT unnest(string_split_regex(url, '[/.?=&#]+')) AS path FROM pages) WHERE path <> '')"""
ORACLE_SQL = {
    "hwc_to_chw": f"""SELECT vec_id, (c * {HEIGHT * WIDTH} + p)::INT AS k, embedding[p * {CHANNELS} + c + 1]::DOUBLE AS value
FROM embeddings, (SELECT unnest(range({CHANNELS})) AS c), (SELECT unnest(range({HEIGHT * WIDTH})) AS p)""",
    "percentile_range_per_channel": f"WITH {_CHANNEL} SELECT channel, round(quantile_cont(value, 0.01::DOUBLE), 9) AS lo, round(quantile_cont(value, 0.99::DOUBLE), 9) AS hi FROM c GROUP BY channel",
    "normalize_uint8": f"""WITH {_CHANNEL}, r AS (SELECT channel, quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.99::DOUBLE) AS hi FROM c GROUP BY channel)
SELECT vec_id, k, {_CODE} FROM c JOIN r USING (channel)""",
    "normalize_uint8_events": f"""WITH r AS (SELECT event_type, quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.99::DOUBLE) AS hi FROM events GROUP BY event_type)
SELECT event_id, {_CODE} FROM events JOIN r USING (event_type)""",
    "layout_detect": """WITH s AS (SELECT p_partkey, [p_size, p_partkey % 5 + 1, p_partkey // 5 % 5 + 1, p_partkey // 25 % 5 + 1, p_partkey // 125 % 5 + 1][:CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 4 END] AS s FROM part)
SELECT p_partkey, CASE
  WHEN len(s) = 5 AND s[5] IN (1, 3) THEN 'BTHWC' WHEN len(s) = 5 AND s[3] IN (1, 3) THEN 'BTCHW' WHEN len(s) = 5 AND s[2] IN (1, 3) THEN 'BCTHW'
  WHEN len(s) = 4 AND s[4] IN (1, 3) THEN 'THWC' WHEN len(s) = 4 AND s[2] IN (1, 3) THEN 'TCHW' ELSE 'none' END AS layout FROM s""",
    "mosaic_geometry": """WITH g AS (SELECT c_custkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n,
    ceil(sqrt(count(*) OVER (PARTITION BY c_nationkey)))::BIGINT AS cols FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
SELECT c_custkey, cols, ceil(n / cols)::BIGINT AS rows, i // cols AS r, i % cols AS c, (i // cols) * 52 AS y0, (i % cols) * 68 AS x0 FROM g""",
    "strip_pad_geometry": """WITH s AS (SELECT label, count(*) AS height FROM embeddings GROUP BY label)
SELECT label, (sum(label + 10) OVER (ORDER BY label) - label - 10)::BIGINT AS x0, height, max(height) OVER () - height AS pad_bottom FROM s""",
    "kind_inference": f"SELECT path, {_KIND} AS kind FROM {_WORDS}",
    "modalities_grouped": f"SELECT kind, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT DISTINCT path, {_KIND} AS kind FROM {_WORDS}) WHERE kind <> 'generic' GROUP BY kind",
    "version_latest": f"SELECT name, arg_max(version, key) AS version, arg_max(path, key) AS path FROM {_VERSIONS} GROUP BY name",
    "versions_sorted_desc": f"SELECT name, string_agg(version, ',' ORDER BY key DESC) AS versions FROM {_VERSIONS} GROUP BY name",
    "catalog_from_listing": """WITH p AS (SELECT DISTINCT string_split_regex(trim(regexp_replace(url, '^[a-z]+://', ''), '/'), '/+') AS x FROM pages),
v AS (SELECT DISTINCT x[1] AS name, coalesce(x[2], '') AS version FROM p)
SELECT name, count(*) AS n_versions, max(version) AS last_version FROM v GROUP BY name""",
}
