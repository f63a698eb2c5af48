"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a seeded hash order; a source whose target exceeds its size queues
twice. A document's virtual finish time is the running total of its source's words, divided by the
source's target; serving all queues by finish time gives every source words in proportion to its
target at any point of the mix. All sources' packets are range-sorted by finish time, running totals
over that order give each its place, and the mix ends where they reach the total budget. A document
in which its source reaches its target is two packets, so the cut falls between packets and every
source gets its target to the word.

Only DataFrame functions are used. Running totals never need a source, or the whole mix, in one
task: the hash is cut into ``BUCKETS`` ranges, a small table of range totals is summed up, and each
range is summed on its own.

Null texts have size 0, null sources are a source of their own (ordered last), repeated rows are
separate documents, an empty table gives an empty mix, and sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.llm.shared import ROW_NAME, SPACE_CLASS, keyed_rows, row_name, word_count, written
from episodica.sources.tables import table

#: Fixed values of the contract: weights by order of source, share of all words, most epochs.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
BUCKETS = 4096

_ALL_BEFORE = (W.unboundedPreceding, -1)


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform 60-bit number of a seed and a document id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """``source_null, source_key, source_size`` with each source's ``target``, in one row per source.

    Targets are ``min(EPOCHS * size, level * weight)`` at the water level where they add up to
    ``SHARE`` of all words. With sources ordered by ``EPOCHS * size / weight`` and all before one
    capped, the level that the rest would share rises up to the first source that it does not cap
    and falls behind it, so the greatest is the water level.
    """
    rank = F.row_number().over(W.orderBy("source_null", "source_key")) - 1
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = sources.withColumn("weight", F.get(weights, (rank % len(WEIGHTS)).cast("int"))).withColumn(
        "cap", F.lit(EPOCHS) * F.col("source_size")
    )
    order = W.orderBy(F.col("cap") / F.col("weight"), "source_null", "source_key")
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = weighed.withColumns(
        {
            "budget": F.lit(SHARE) * F.sum("source_size").over(all_rows),
            "capped": F.coalesce(F.sum("cap").over(order.rowsBetween(*_ALL_BEFORE)), F.lit(0)),
            "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    reached = F.max("level").over(all_rows)
    return levels.select(
        "source_null",
        "source_key",
        "source_size",
        F.least(F.col("cap").cast("double"), reached * F.col("weight")).alias("target"),
    )


def queues(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Every document's place in its source's queue, one row per document.

    Columns: ``doc_id, size, source_size, target``, the shuffle key ``u``, ``queue_bucket`` and
    ``queue_row`` (together with the source an identity of the row), ``words_before`` in the queue,
    and the narrow columns named in ``carry``.
    """
    sized = written(
        docs.select(
            F.col("doc_id"),
            word_count(F.col(text)).alias("size"),
            F.col("source").isNull().alias("source_null"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
            shuffle_key(F.col("doc_id")).alias("u"),
            F.xxhash64(text).alias("tie"),
            *carry,
        ).withColumn("queue_bucket", F.shiftright("u", 48)),
        "mix-sizes",
    )
    source = ["source_null", "source_key"]
    ranges = sized.groupBy(*source, "queue_bucket").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy(*source).agg(F.sum("range_size").alias("source_size")))
    before = F.sum("range_size").over(W.partitionBy(*source).orderBy("queue_bucket").rowsBetween(*_ALL_BEFORE))
    starts = ranges.withColumn("range_start", F.coalesce(before, F.lit(0))).join(targets, source)
    inside = W.partitionBy(*source, "queue_bucket").orderBy("u", "doc_id", "size", "tie")
    return (
        sized.join(starts, [*source, "queue_bucket"])
        .withColumns(
            {
                "queue_row": F.row_number().over(inside),
                "words_before": F.col("range_start")
                + F.coalesce(F.sum("size").over(inside.rowsBetween(*_ALL_BEFORE)), F.lit(0)),
            }
        )
        .select("doc_id", "size", "source_size", "target", *source, "u", "queue_bucket", "queue_row", "words_before", *carry)
    )


def packets(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """One row per document, epoch and packet with its ``virtual_finish``.

    A document is one packet of its words, but where its source reaches its target inside it, it is
    two, parted at the target: at any virtual time up to 1 every source has then sent its share.
    """
    served = (
        queues(docs, carry, text)
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
        .withColumn("start", F.col("epoch") * F.col("source_size") + F.col("words_before"))
    )
    parted = F.least(F.col("start") + F.col("size"), F.greatest(F.col("start"), F.floor("target")))
    cuts = F.when((parted > F.col("start")) & (parted < F.col("start") + F.col("size")), F.array(parted, F.col("start") + F.col("size")))
    whole = F.array(F.col("start") + F.col("size"))
    ends = served.select("*", F.posexplode(F.coalesce(cuts, whole)).alias("packet", "end"))
    begin = F.when(F.col("packet") == 0, F.col("start")).otherwise(parted)
    return ends.withColumns(
        {
            "packet_words": (F.col("end") - begin).cast("long"),
            "virtual_finish": F.when(F.col("target") > 0, F.col("end") / F.col("target")),
        }
    ).drop("start", "end")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """One row per packet in the global order of virtual finish times, with its place and words taken.

    ``mix_start`` is the number of words of the mix before the packet; ``words_taken`` what is left of
    the total budget, the sum of all targets in whole words, at that place: 0 beyond the cut.
    """
    # Packets without words share no finish time worth sorting by; their hash deals them out.
    counts = F.col("packet_words") > 0
    bucket = F.when(counts, F.floor(F.coalesce("virtual_finish", F.lit(0.0)) * BUCKETS)).otherwise(-1 - F.shiftright("u", 48))
    served = written(packets(docs, carry, text).withColumn("finish_bucket", bucket.cast("long")), "mix-served")
    totals = served.where(counts).groupBy("finish_bucket").agg(F.sum("packet_words").alias("bucket_words"))
    starts = totals.select(
        "finish_bucket",
        F.coalesce(F.sum("bucket_words").over(W.orderBy("finish_bucket").rowsBetween(*_ALL_BEFORE)), F.lit(0)).alias("bucket_start"),
    )
    targets = served.groupBy("source_null", "source_key").agg(F.floor(F.max("target")).alias("whole"))
    budget = targets.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("budget"))
    inside = W.partitionBy("finish_bucket").orderBy(*MIX_ORDER)
    place = F.coalesce("bucket_start", F.lit(0)) + F.coalesce(F.sum("packet_words").over(inside.rowsBetween(*_ALL_BEFORE)), F.lit(0))
    left = F.greatest(F.lit(0), F.col("budget") - F.col("mix_start"))
    return (
        served.join(starts, "finish_bucket", "left")
        .withColumn("mix_start", place)
        .crossJoin(F.broadcast(budget))  # one row
        .withColumn("words_taken", F.least(F.col("packet_words"), left).cast("long"))
        .drop("bucket_start", "finish_bucket", "budget")
    )


#: The order of packets whose virtual finish times are equal.
MIX_ORDER = ("virtual_finish", "source_null", "source_key", "epoch", "queue_bucket", "queue_row", "packet")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ")
    seen = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("chars")),
        lambda a, p: F.when(a["words"] >= n, a).otherwise(
            F.struct(
                (a["words"] + F.when(p != "", 1).otherwise(0)).alias("words"),
                (a["chars"] + F.length(p) + 1).alias("chars"),
            )
        ),
    )
    return F.substring(text, F.lit(1), (seen["chars"] - 1).cast("int"))


def mixed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents of the mix with all their columns, in its order: once per epoch that takes words of them.

    Rows come range-sorted by their place, partition after partition. A document that the cut divides
    keeps its first words, and ``n_chars`` follows its text. Rows are matched by their id and a hash
    of all their columns; equal rows are stored once and served as often as there are.
    """
    keyed = keyed_rows(docs)
    narrow = keyed.select("doc_id", "__row", F.col("__kept").getField("source").alias("source"), F.col("__kept").getField(text).alias("text"))
    served = mix(narrow, ("__row",)).where("words_taken > 0")
    servings = served.groupBy("doc_id", "__row", "source_null", "source_key", "queue_bucket", "queue_row", "epoch").agg(
        F.sum("words_taken").alias("__n"), F.min("mix_start").alias("__place")
    )
    named = row_name(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    wanted = servings.select(*[c.alias(name) for name, c in named.items()], "__n", "__place")
    kept = keyed.withColumns(named).dropDuplicates([*ROW_NAME]).join(wanted, [*ROW_NAME])
    n, whole = F.col("__n"), F.col("__kept").getField(text)
    given = {c: F.col("__kept").getField(c) for c in docs.columns}
    out = kept.select("__place", "__kept", F.when(n < word_count(whole), first_words(whole, n)).otherwise(whole).alias("__cut"))
    given[text] = F.col("__cut")
    if "n_chars" in given:
        given["n_chars"] = F.length("__cut").cast(docs.schema["n_chars"].dataType)
    return out.repartitionByRange("__place").sortWithinPartitions("__place").select(*[v.alias(c) for c, v in given.items()])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, its source's size and target, and its place in the mix, -1 if none."""
    served = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    row = ["source_null", "source_key", "queue_bucket", "queue_row"]
    return (
        served.groupBy(*row, "doc_id", "size", "source_size", "target")
        .agg(F.sum("words_taken").alias("taken"), F.coalesce(F.min(F.when(F.col("words_taken") > 0, F.col("mix_start"))), F.lit(-1)).alias("mix_start"))
        .select("doc_id", "size", "source_size", "target", "taken", "mix_start")
    )


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^{SPACE_CLASS}]+'))::BIGINT AS size,
         cast(concat('0x', substr(md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, 'null'))), 1, 15)) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::DOUBLE AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum({EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY {EPOCHS} * source_size / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size,
         least(({EPOCHS} * source_size)::DOUBLE,
               weight * max(level) OVER ()) AS target
  FROM l
), q AS (
  SELECT row_number() OVER () AS rid, doc_id, d.source, u, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT q.*, epoch, before + epoch * source_size AS a, before + epoch * source_size + size AS z, floor(target)::BIGINT AS cut
  FROM q, (SELECT unnest(range({EPOCHS})) AS epoch)
), p AS (
  SELECT *, least(z, cut) - a AS n, least(z, cut) / target AS finish FROM e WHERE a < cut AND size > 0
  UNION ALL
  SELECT *, z - greatest(a, cut) AS n, z / target AS finish FROM e WHERE z > cut AND size > 0
), m AS (
  SELECT rid, n, coalesce(sum(n) OVER (ORDER BY finish, source NULLS LAST, epoch, u, doc_id, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS mix_start
  FROM p
), k AS (
  SELECT rid, mix_start, greatest(0, least(n, (SELECT sum(floor(target)) FROM t)::BIGINT - mix_start)) AS taken FROM m
), g AS (
  SELECT rid, sum(taken)::BIGINT AS taken, min(mix_start) FILTER (taken > 0) AS mix_start FROM k GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(mix_start, -1)::BIGINT AS mix_start FROM q LEFT JOIN g USING (rid)
"""
