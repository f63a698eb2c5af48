"""Importance resampling towards a target corpus by hashed word runs.

Features of a text are its runs of 1 to ``longest`` words, joined by one space and filed under a bucket: the CRC of
their bytes modulo ``buckets``. One scan finds all of them: a ring holds the running CRC of the runs that began at the
last words, and the next word extends each by a space and itself and begins one more. A bucket's gain is the log ratio
of its smoothed shares in target and corpus; a document's weight is the mean gain of its features; its score adds
Gumbel noise drawn from its id, so that the best scores are a draw without replacement by weight.

The scan emits buckets only; they are written once, counted, and looked up in the table of gains, whose length is the
parameter ``buckets``. Scores are whole thousandths of natural logarithms of 64-bit counts, fewer than ``2 ** 18``
values whatever the corpus, so places follow from the counts per score and an order inside each score.

Null texts have no words. A null id draws its noise as an empty one and comes last among ties. Rows of one id, size and
weight share a score and take consecutive places; equal rows are drawn as often as they have places. An empty target
has a share of ``1 / buckets`` everywhere; an empty corpus gives no rows. Other columns, whatever their names, pass
through ``resampled``.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.llm.shared import free_name, in_small_batches, row_key, written
from episodica.sources.tables import table

#: Words of ASCII digits and letters, and of every other character outside ASCII, in lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Resampling:
    """Features, size of the draw in hundredths of the documents with enough words, and seed of the noise."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


RESAMPLING = Resampling()


def feature_buckets(text: str | None, longest: int, buckets: int) -> tuple[int, list[int]]:
    """Number of words, and the bucket of every feature in the order of their last words."""
    words = WORD.findall((text or "").encode().lower())
    if longest == 1:  # the ring holds one state, that of the word
        return len(words), [crc32(w) % buckets for w in words]
    found, ring = [], deque(maxlen=longest)  # states of the runs that begin at the last words
    for word in words:
        step = b" " + word
        for k, state in enumerate(ring):
            ring[k] = crc32(step, state)
        ring.append(crc32(word))
        found += [state % buckets for state in ring]
    return len(words), found


def _emit(longest: int, buckets: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature_buckets(t.as_py(), longest, buckets) for t in batch.column(batch.num_columns - 1)]
            arrays = [pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], "n_words", "buckets"])

    return emit


def featured(docs: DataFrame, how: Resampling = RESAMPLING, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The columns of ``carry`` with ``n_words`` and ``buckets``, written as a table."""
    narrow = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1]]
    emitted = in_small_batches(narrow).mapInArrow(_emit(how.longest, how.buckets), ", ".join([*kept, "n_words bigint", "buckets array<int>"]))
    return written(emitted, "features")


def bucket_counts(features: DataFrame) -> DataFrame:
    """``bucket, n``: at most ``buckets`` rows, summed in every task before they are exchanged."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` for every bucket, in floored thousandths."""
    spark = corpus.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = (
        every.join(bucket_counts(corpus).withColumnRenamed("n", "s"), "bucket", "left")
        .join(bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "left")
        .na.fill(0, ["s", "t"])
    )
    totals = counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    t, s = ((F.col(c) + 1).cast("double") for c in ("t", "s"))
    all_t, all_s = ((F.col(c) + buckets).cast("double") for c in ("all_t", "all_s"))
    return counted.crossJoin(F.broadcast(totals)).select(  # one row
        "bucket", F.floor(F.log(t * all_s / (s * all_t)) * 1000).cast("long").alias("gain")
    )


def _weigh(table_of_gains: np.ndarray) -> Callable:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sums = np.concatenate([[0], np.cumsum(table_of_gains[lists.flatten().to_numpy(zero_copy_only=False)])])
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            weight = np.where(sizes > 0, total // np.maximum(sizes, 1), 0)
            arrays = [pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id, in floored thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def scored(docs: DataFrame, target: DataFrame, how: Resampling = RESAMPLING, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``doc_id``, the columns of ``carry``, ``n_words, n_features, weight, score``: one row per document, as a table."""
    features = featured(docs, how, ("doc_id", *carry), text)
    found = gains(features, featured(target, how, (), text), how.buckets).collect()  # ``buckets`` rows
    table_of_gains = np.zeros(how.buckets, np.int64)
    table_of_gains[[r.bucket for r in found]] = [r.gain for r in found]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema[:-1]]
    weighed = features.mapInArrow(_weigh(table_of_gains), ", ".join([*kept, "n_features bigint", "weight bigint"]))
    return written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), how.seed)), "scores")


def ranked(scores: DataFrame, how: Resampling = RESAMPLING) -> DataFrame:
    """``scores`` with ``rank``, the place of a drawn document, null for the others.

    Rows of equal values are one row with a count until they are placed, so that no group of copies is ordered as such.
    """
    able = F.col("n_words") >= how.least_words
    names = [F.col(f"`{c}`") for c in scores.columns]
    by_score = scores.where(able).groupBy("score").agg(F.count("*").alias("n"))
    falling = W.orderBy(F.desc("score"))  # one row per score, a bounded number
    places = by_score.select(
        "score", (F.sum("n").over(falling) - F.col("n")).alias("start"), F.floor(F.sum("n").over(W.partitionBy()) * how.percent / 100).alias("drawn")
    ).where("start < drawn")
    reached = F.broadcast(places)
    groups = scores.where(able).join(reached, "score").groupBy(*names, "start", "drawn").agg(F.count("*").alias("n"))
    inside = W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), *[c for c in names])
    placed = groups.withColumn("first", F.col("start") + F.sum("n").over(inside) - F.col("n") + 1)
    place = F.explode(F.sequence("first", F.col("first") + F.col("n") - 1))
    drawn = placed.select(*names, "drawn", place.alias("rank")).select(*names, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    below = scores.where(able).join(reached, "score", "left_anti").unionByName(scores.where(~able))
    return drawn.unionByName(below.withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = RESAMPLING, text: str = "text") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns."""
    key, n = free_name(docs.columns, "row_key"), free_name(docs.columns, "row_draws")
    keyed = docs.withColumn(key, row_key(docs))
    draws = ranked(scored(keyed, target, how, (key,), text), how).where("rank is not null").groupBy("doc_id", key).agg(F.count("*").alias(n))
    draws = draws.select(F.col("doc_id").alias(free_name([*keyed.columns, n], "drawn_id")), F.col(key).alias(free_name([*keyed.columns, n], "drawn_key")), n)
    drawn_id, drawn_key = draws.columns[:2]
    kept = keyed.dropDuplicates(["doc_id", key]).join(draws, F.col("doc_id").eqNullSafe(F.col(drawn_id)) & (F.col(key) == F.col(drawn_key)))
    copies = free_name([*keyed.columns, *draws.columns], "copy")
    return kept.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place of every document in a draw that resembles the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = scored(docs, table(spark, sf_dir, "benchmark").select("text"))
    return ranked(scores).select("doc_id", "n_features", "weight", "score", "rank")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
#: CRC-32 byte by byte from its polynomial, for the column ``s`` beside the one-row table ``crc_table(tab)``.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256))::BIGINT AS i)
)"""
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(s)) + 1, 2), lambda i:
    (16 * (strpos('0123456789ABCDEF', hex(s)[i]) - 1) + strpos('0123456789ABCDEF', hex(s)[i + 1]) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])))"""
_H = RESAMPLING
OP12_SQL = f"""
WITH {CRC_TABLE_SQL}, d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS ws FROM documents
), dw AS (SELECT rid, unnest(ws) AS s FROM d
), bw AS (SELECT unnest({_SQL_WORDS}) AS s FROM benchmark
), w AS (
  SELECT s, ({CRC_SQL} % {_H.buckets})::BIGINT AS bucket FROM (SELECT DISTINCT s FROM (SELECT s FROM dw UNION ALL SELECT s FROM bw)), crc_table
), cs AS (SELECT bucket, count(*) AS s FROM dw JOIN w USING (s) GROUP BY bucket
), ct AS (SELECT bucket, count(*) AS t FROM bw JOIN w USING (s) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {_H.buckets})
                                 / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {_H.buckets}))))::BIGINT AS gain
  FROM cs LEFT JOIN ct USING (bucket)
), m AS (SELECT rid, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN w USING (s) JOIN g USING (bucket) GROUP BY rid
), h AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('{_H.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (rid)
), c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h
), k AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, floor({_H.percent} * count(*) OVER () / 100) AS drawn
  FROM c WHERE n_features >= {_H.least_words}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM c LEFT JOIN k USING (rid)
"""
