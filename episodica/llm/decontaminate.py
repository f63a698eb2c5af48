"""Benchmark decontamination: item-sized windows, SimHash blocks, exact weighted similarity.

A window of a document is as long as a benchmark item; a document shorter than the item is one. All
windows are in question, at every start. Their similarity to the item, of the counts of shingles of
``SHINGLE_WORDS`` words, is exact and alone decides; what comes before it leaves out no window that
could reach the threshold ``t``:

* a window that is similar enough shares so many shingles with its item that at least ``need`` of
  its places hold one, so only starts with so many hits in reach are looked at;
* it differs from its item, of ``n`` shingles, in at most ``2 n (1 - t) / (1 + t)`` shingles, lost and
  put in. A fingerprint's bit whose majority is larger than that is firm: no similar window has it
  otherwise. An item's firm bits are a block in which a window's fingerprint must agree with its own;
  the other bits are the radius that this item leaves.

Only DataFrame functions are used. The benchmark's shingles are broadcast while there are at most
``BROADCAST_SHINGLES`` of them and joined by hash otherwise, in one pass over the documents either
way; candidate starts and the digests of hit texts are broadcast up to ``BROADCAST_STARTS``.

Items of fewer words than a shingle are one shingle of their own length. Null and empty texts and
items match nothing; rows that repeat a document or item give one result; results are by id, so rows
of one id, or without one, are one document there, while ``decontaminated`` tells rows apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import free_name, with_computed, words, written
from episodica.sources.tables import table

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BITS = 64
#: Starts of a text that share one slice of its hashes.
SLICE = 1024

#: Most shingles of a benchmark, and most candidate starts or hit texts, that are broadcast.
BROADCAST_SHINGLES = 200_000
BROADCAST_STARTS = 200_000


def shingle_hashes(tokens: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order."""
    n = F.size(tokens) - width + 1
    at = lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Majority of the hashes' bits; a shingle weighs as often as it occurs."""
    bit_counts = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("getbit", h, b).cast("int")),
    )
    return F.aggregate(
        F.transform(
            bit_counts, lambda c, b: F.when(2 * c > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        ),
        F.lit(0).cast("long"),
        lambda a, x: a.bitwiseOR(x),
    )


def firm_bits(hashes: Column, threshold: float) -> Column:
    """Bits of ``simhash`` that are the same for every window of at least that similarity, and of no more shingles."""
    n = F.size(hashes)
    margins = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + 2 * F.call_function("getbit", h, b).cast("int") - 1),
    )
    change = 2 * n * F.lit((1 - threshold) / (1 + threshold)) + 1e-6
    bits = F.transform(margins, lambda m, b: F.when(F.abs(m) > change, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def ranked(hashes: Column) -> Column:
    """A multiset as a set: every hash, sorted, with how often it came before."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, i - F.array_position(hashes, x)))


def benchmark_items(benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``item, item_id, n_item, width, item_hashes, item_ranked, item_print, item_firm`` of every item with a word.

    ``item`` tells items of one id and different texts apart.
    """
    tokens = with_computed(benchmark.select("item_id", "text"), "tokens", words(F.lower("text")))
    tokens = tokens.select("item_id", "tokens").where(F.size("tokens") > 0).distinct()
    n = F.size("tokens")
    by_width = F.coalesce(
        *[F.when(n == w, shingle_hashes(F.col("tokens"), w)) for w in range(1, SHINGLE_WORDS)], shingle_hashes(F.col("tokens"), SHINGLE_WORDS)
    )
    hashed = with_computed(tokens.select("item_id", n.alias("n_item"), F.least(n, F.lit(SHINGLE_WORDS)).alias("width"), "tokens"), "item_hashes", by_width)
    order = with_computed(hashed.drop("tokens"), "__sorted", F.array_sort("item_hashes"))
    made = order.withColumns({"item": F.xxhash64("item_id", "item_hashes"), "item_ranked": ranked(F.col("__sorted"))}).drop("__sorted")
    return with_computed(with_computed(made, "item_print", simhash(F.col("item_hashes"))), "item_firm", firm_bits(F.col("item_hashes"), threshold))


def text_hashes(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``n_words`` and the ``hashes`` of its text's shingles instead of its text."""
    tokens = with_computed(docs, "tokens", words(F.lower("text"))).drop("text").withColumn("n_words", F.size("tokens"))
    return with_computed(tokens, "hashes", shingle_hashes(F.col("tokens"), width)).drop("tokens")


def window_size(width: int) -> Column:
    """Shingles of a window: the item's, or the document's where it is shorter."""
    return F.least("n_words", "n_item") - width + 1


def candidate_starts(docs: DataFrame, items: DataFrame, width: int, threshold: float, small: bool) -> DataFrame:
    """``doc_id, digest, item, starts``: where windows hold enough shingles of the item to be similar.

    ``docs`` has ``doc_id, digest, text``. Of ``need`` hits in a row, the first and last must lie in
    the window, which bounds its start. Rows of one id and text have the same places, each kept once,
    so a group of copies is no longer than its text.
    """
    seeds = items.select("item", "n_item", F.explode(F.array_distinct("item_hashes")).alias("hash"))
    hits = text_hashes(docs, width).select("doc_id", "digest", "n_words", F.posexplode("hashes").alias("p", "hash"))
    met = hits.join(F.broadcast(seeds) if small else seeds, "hash")
    by_item = met.groupBy("doc_id", "digest", "n_words", "item", "n_item").agg(F.collect_set("p").alias("ps"))
    ordered = with_computed(by_item, "at", F.array_sort("ps")).drop("ps")
    size = window_size(width)
    need = F.ceil((size + F.col("n_item") - width + 1) * F.lit(threshold / (1 + threshold)) - 1e-6).cast("int")
    measured = ordered.withColumns({"size": size, "need": need}).where(F.size("at") >= F.col("need"))
    last = F.greatest(F.lit(0), F.col("n_words") - F.col("n_item"))

    def reach(k: Column) -> Column:
        low = F.greatest(F.lit(0), F.get("at", k + F.col("need") - 1) - F.col("size") + 1)
        high = F.least(F.get("at", k), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), reach)))
    return measured.select("doc_id", "digest", "item", starts.alias("starts")).where(F.size("starts") > 0)


def similar_windows(docs: DataFrame, candidates: DataFrame, items: DataFrame, width: int, threshold: float, small: bool) -> DataFrame:
    """``doc_id, item_id, similarity, start`` of all windows that reach the threshold."""
    few = candidates.agg(F.coalesce(F.sum(F.size("starts") + 1), F.lit(0)).alias("n")).first().n <= BROADCAST_STARTS
    wanted = candidates.withColumnsRenamed({"doc_id": "__of", "digest": "__digest"})
    same = F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("digest") == F.col("__digest"))
    chosen = docs.join(F.broadcast(wanted) if few else wanted, same).select("doc_id", "text", "item", "starts")
    about = items.select("item", "item_id", "n_item", "item_ranked", "item_print", "item_firm")
    paired = text_hashes(chosen, width).join(F.broadcast(about) if small else about, "item")
    sized = paired.withColumn("size", window_size(width))
    # Rows that are multiplied carry the hashes of their own starts only.
    parts = F.transform(
        F.array_distinct(F.transform("starts", lambda s: F.floor(s / SLICE).cast("int"))),
        lambda k: F.struct(
            (k * SLICE).alias("base"),
            F.filter("starts", lambda s: F.floor(s / SLICE) == k).alias("starts"),
            F.slice("hashes", k * SLICE + 1, F.col("size") + SLICE - 1).alias("hashes"),
        ),
    )
    dealt = sized.withColumn("part", F.explode(parts)).drop("hashes", "starts")
    started = dealt.select("*", F.explode("part.starts").alias("start"))
    cut = with_computed(started, "window", F.slice("part.hashes", F.col("start") - F.col("part.base") + 1, F.col("size"))).drop("part", "size")
    printed = with_computed(cut, "window_print", simhash(F.col("window")))
    near = printed.where(F.col("window_print").bitwiseXOR(F.col("item_print")).bitwiseAND(F.col("item_firm")) == 0)
    shared = F.size(F.array_intersect(ranked(F.col("__sorted")), F.col("item_ranked")))
    counted = with_computed(with_computed(near, "__sorted", F.array_sort("window")), "shared", shared)
    similarity = F.col("shared") / (F.size("window") + F.size("item_ranked") - F.col("shared"))
    return counted.select("doc_id", "item_id", similarity.alias("similarity"), "start").where(F.col("similarity") >= threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, similarity, start``: the best window of every document for every item it holds."""
    named = docs.select("doc_id", F.xxhash64(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    items = written(benchmark_items(benchmark, threshold), "items")
    sizes = items.groupBy("width").agg(F.sum(F.size("item_hashes")).alias("n")).collect()  # at most SHINGLE_WORDS rows
    parts = []
    for width, n in sizes:
        of_width, small = items.where(F.col("width") == width), n <= BROADCAST_SHINGLES
        candidates = written(candidate_starts(named, of_width, width, threshold, small), "window-starts")
        parts.append(similar_windows(named, candidates, of_width, width, threshold, small))
    if not parts:
        return docs.limit(0).select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("start"))
    best = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).cast("long").alias("start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Rows are told apart by a digest of their text, which alone decides, not by their ids.
    """
    digest = F.unhex(F.sha2(F.col(f"`{text}`"), 256))
    found = contaminated(docs.select(digest.alias("doc_id"), F.col(f"`{text}`").alias("text")), benchmark)
    name = free_name(docs.columns, "hit")
    hit = written(found.select(F.col("doc_id").alias(name)).distinct(), "hits")
    return docs.join(F.broadcast(hit) if hit.count() <= BROADCAST_STARTS else hit, digest == F.col(name), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the similarity of their best window."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT row_number() OVER () AS bid, item_id, ws FROM (
    SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark)
), bs AS (
  SELECT bid, item_id, len(ws) AS n, ws[q+1:q+5] AS sh FROM (SELECT bid, item_id, ws, unnest(range(len(ws) - 4)) AS q FROM b WHERE len(ws) >= 5)
), ds AS (
  SELECT rid, doc_id, len(ws) AS m, p, ws[p+1:p+5] AS sh FROM (SELECT rid, doc_id, ws, unnest(range(len(ws) - 4)) AS p FROM d WHERE len(ws) >= 5)
), i AS (
  SELECT bid, item_id, n, sh, count(*) AS k FROM bs GROUP BY ALL
), h AS (
  SELECT rid, doc_id, m, p, bid, item_id, n, sh, k FROM ds JOIN i USING (sh)
), c AS (
  SELECT DISTINCT rid, doc_id, bid, item_id, m, n FROM h
), t AS (
  SELECT rid, doc_id, bid, item_id, m, n, unnest(range(greatest(0, m - n) + 1)) AS start FROM c
), w AS (
  SELECT t.doc_id, t.rid, t.bid, t.item_id, t.m, t.n, t.start, sh, least(count(*), any_value(k)) AS k
  FROM t JOIN h ON t.rid = h.rid AND t.bid = h.bid AND p >= start AND p <= start + t.n - 5 GROUP BY ALL
), v AS (
  SELECT doc_id, item_id, start, sum(k) / (least(m, n) - 4 + n - 4 - sum(k))::DOUBLE AS similarity
  FROM w GROUP BY rid, bid, doc_id, item_id, m, n, start
)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, [-similarity, start])::BIGINT AS start
FROM v WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
