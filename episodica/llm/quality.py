"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once over each whole text. The ledger stores the measurements and one
failure bit per rule; policies are versioned masks over those bits, so that a policy can be
changed, compared or ablated without touching a text again.

Null texts have no words; repeated rows are judged each on their own; other columns pass through
``ledger`` untouched, and an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from episodica.llm.shared import free_name, in_small_batches, written
from episodica.sources.tables import table

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WHITE_SPACE = " \t\n\v\f\r"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """One rule: its bit in the ledger and the predicate on measurements that fails a document."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "many_symbols", "5 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "4 * n_dup_lines > n_words"),
    Rule(4, "long_words", "word_chars > 40 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        """The bits of the chosen rules."""
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_windows")),
    "v1": Policy("v1", ("few_words", "repeated_windows", "many_symbols")),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}
BASE, DEFAULT = POLICIES["base"], POLICIES["v1"]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set[tuple] = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered = end = 0
    for start, window in enumerate(windows):
        if window in twice:
            covered += start + width - max(end, start)
            end = start + width
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    words = text.encode().split()  # bytes split at exactly the six ASCII white-space characters
    lines = [line for line in text.split("\n") if line.strip(WHITE_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(text.as_py()) for text in batch.column(batch.num_columns - 1)]
        columns = zip(*found, strict=True) if found else [[] for _ in MEASURES]
        arrays = [pa.array(values, pa.int64()) for values in columns]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *MEASURES]
        )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the measurements and ``failed``, the bits of failed rules.

    Columns of ``docs`` that carry a name of the ledger's own are left out.
    """
    own = {*MEASURES, "failed"}
    keep = [c for c in docs.columns if c != text and c not in own]
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(keep, "text")))
    schema = StructType([*narrow.schema[:-1], *[StructField(m, LongType()) for m in MEASURES]])
    measured = in_small_batches(narrow).mapInArrow(_measure_batches, schema)
    return measured.withColumn("failed", failure_bits())


def failure_bits() -> Column:
    """Bitwise or of ``1 << bit`` over the rules that fail."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return bits


def kept_by(policy: Policy) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that it alone rejects.

    Entries are first counted by their failure bits, at most ``2 ** len(RULES)`` rows, from which
    every ablation follows by bit operations.
    """
    by_bits = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules]
    return (
        by_bits.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        )
    )


def written_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger as a table without texts, from which any policy, also a later one, is applied without measuring again."""
    return written(ledger(docs, text), "ledger")


def compared(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """Per policy: documents that it keeps, documents that it and no other rejects, and rules that reject any.

    Entries are counted by their failure bits first, at most ``2 ** len(RULES)`` rows.
    """
    by_bits = entries.groupBy("failed").agg(F.count("*").alias("n"))
    rejects = [F.col("failed").bitwiseAND(F.lit(p.mask)) != 0 for p in policies]
    rows = []
    for k, p in enumerate(policies):
        others = [r for j, r in enumerate(rejects) if j != k]
        alone = reduce(lambda a, b: a & ~b, others, rejects[k])
        rows.append(F.struct(F.lit(p.version).alias("policy"), rejects[k].alias("out"), alone.alias("alone"), F.col("failed").bitwiseAND(F.lit(p.mask)).alias("bits")))
    told = by_bits.select("n", F.explode(F.array(*rows)).alias("p")).select("n", "p.*")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return told.groupBy("policy").agg(count(~F.col("out")).alias("n_kept"), count(F.col("alone")).alias("n_rejected_alone"), F.bit_or("bits").alias("rules"))


def filter_documents(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns.

    The text travels through the measuring step once, so that no join on ids is needed.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    return ledger(held, "__text").where(kept_by(policy)).select("__row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of the default policy for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base_failed = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return ledger(docs).select(
        "doc_id",
        *MEASURES,
        base_failed.alias("base_failed"),
        (~base_failed & kept_by(DEFAULT)).alias("kept"),
        F.col("failed").alias("failed_bits"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fail every rule, and those that it alone rejects, under the policy of all rules."""
    return ablation(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), POLICIES["v2"])


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of the policy over one written ledger of all documents."""
    return compared(written_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), list(POLICIES.values()))


OP7_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c, d, e) AS n
  FROM (SELECT rid, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c, ws[i+3] AS d, ws[i+4] AS e
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5))
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM g, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), f AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
                 + 4 * (5 * n_symbols > n_words)::INT + 8 * (4 * n_dup_lines > n_words)::INT
                 + 16 * (word_chars > 40 * n_words)::INT AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 7) = 0 AS kept, failed_bits
FROM f
"""

ABLATION_SQL = f"""
WITH q AS ({OP7_SQL}), r AS (SELECT * FROM (VALUES {", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES)}) v(rule, bit))
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_failed_alone
FROM q, r GROUP BY rule
"""

POLICIES_SQL = f"""
WITH q AS ({OP7_SQL}), p AS (SELECT * FROM (VALUES {", ".join(f"('{p.version}', {p.mask})" for p in POLICIES.values())}) v(policy, mask))
SELECT policy, count(*) FILTER (failed_bits & mask = 0) AS n_kept,
       count(*) FILTER (failed_bits & mask <> 0 AND (SELECT count(*) FROM p o WHERE o.policy <> p.policy AND failed_bits & o.mask <> 0) = 0) AS n_rejected_alone,
       bit_or(failed_bits & mask) AS rules
FROM q, p GROUP BY policy
"""
