r"""Chat formatting in budgeted windows of whole turns.

A conversation's turns are written as ``<|role|>\ntext<|end|>\n``. Inside roles and texts every
``\``, ``<``, ``[`` and ``|`` is followed by a backslash, so no control string of this template, nor
of the common ones (``</s>``, ``[INST]``, ``<|...|>``), can come out of a text, and dropping that
backslash gives the text back.

Windows: prefix sums of the turns' tokens cut a conversation into spans of whole turns. A span holds
the turns that lie inside one stretch of ``new_budget`` tokens; a turn that crosses the end of its
stretch is a span of its own. So no span exceeds the budget unless one turn does, and no turn is
dropped or cut. Every later window repeats the leading system turn, and of the turns before it up to
``history_turns`` that fit in ``history_tokens``; repeated targets are masked, so each assistant text
is under the loss mask exactly once.

Only DataFrame functions are used. Null texts and roles are empty; a null conversation id is a
conversation of its own; ties of ``turn`` are ordered by role and text, null turns come first;
repeated rows are separate turns; an empty table gives no windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from episodica.sources.tables import table

END = "<|end|>\n"
SPECIAL = r"([\\<\[|])"
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and what of them repeated history may take."""

    window_tokens: int = 512
    history_tokens: int = 128
    history_turns: int = 2
    least_new: int = 64


BUDGET = Budget()


def escape(text: Column) -> Column:
    """Put a backslash behind every special character."""
    return F.regexp_replace(text, SPECIAL, r"$1\\")


def unescape(text: Column) -> Column:
    """Inverse of ``escape``."""
    return F.regexp_replace(text, SPECIAL + r"\\", "$1")


def turn_tokens(text: Column) -> Column:
    """Token estimate of a turn: a quarter of its characters, and 4 for its marks."""
    return F.floor((F.length(text) + 3) / 4) + 4


def format_windows(conversations: DataFrame, budget: Budget = BUDGET, tokens: str | None = None) -> DataFrame:
    """``conv_id, window, formatted, loss_spans, n_repeated``: one row per window.

    ``loss_spans`` are ``(start, length)`` in code points of ``formatted``; the first ``n_repeated``
    turns of a window are repeated ones. ``tokens`` names a column of the turns' tokens; where it is
    null, and without it, they are estimated.
    """
    counted = [] if tokens is None else [F.greatest(F.lit(0), F.col(f"`{tokens}`").cast("long")).alias("given")]
    count = turn_tokens(F.col("text")) if tokens is None else F.coalesce("given", turn_tokens(F.col("text")))
    turns = conversations.select(
        *counted,
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    conv = W.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    placed = (
        turns.withColumns({"i": F.row_number().over(order) - 1, "head": head, "body": escape(F.col("text"))})
        .withColumn("is_system", (F.col("i") == 0) & (F.col("role") == SYSTEM_ROLE))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .withColumn("tokens", F.when(F.col("is_system"), 0).otherwise(count))
        .withColumn("system_tokens", F.max(F.when(F.col("is_system"), count).otherwise(0)).over(conv))
        .withColumn("system_piece", F.max(F.when(F.col("is_system"), F.col("piece"))).over(conv))
        .withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn(
            "stretch",
            F.greatest(F.lit(budget.least_new), F.lit(budget.window_tokens - budget.history_tokens) - F.col("system_tokens")),
        )
    )
    at = F.floor(F.col("start") / F.col("stretch"))
    crosses = F.floor((F.col("start") + F.greatest(F.col("tokens"), F.lit(1)) - 1) / F.col("stretch")) > at
    spans = placed.withColumn("window", (2 * at + crosses.cast("int")).cast("long"))
    spans = spans.withColumn("first", ~F.col("window").eqNullSafe(F.lag("window").over(order)))

    def copy(kind: int, window: Column, i: Column, piece: Column, target: Column) -> Column:
        return F.struct(
            window.alias("window"),
            F.lit(kind).alias("kind"),
            i.alias("i"),
            piece.alias("piece"),
            F.length("head").alias("skip"),
            F.when(target, F.length("body")).alias("loss"),
        )

    # A turn is copied into its own window, into those that repeat it, and the first turn of each
    # window brings the system turn along.
    copies = [copy(2, F.col("window"), F.col("i"), F.col("piece"), F.col("role") == TARGET_ROLE)]
    later = {}
    for k in range(1, budget.history_turns + 1):
        later |= {f"w{k}": F.lead("window", k).over(order), f"f{k}": F.lead("first", k).over(order), f"s{k}": F.lead("start", k).over(order)}
        fits = F.col(f"f{k}") & ~F.col("is_system") & (F.col(f"s{k}") - F.col("start") <= budget.history_tokens)
        copies.append(F.when(fits, copy(1, F.col(f"w{k}"), F.col("i"), F.col("piece"), F.lit(False))))
    brings = F.col("first") & (F.col("i") > 0) & F.col("system_piece").isNotNull()
    copies.append(F.when(brings, copy(0, F.col("window"), F.lit(0), F.col("system_piece"), F.lit(False))))
    dealt = spans.withColumns(later).select("conv_id", F.explode(F.array_compact(F.array(*copies))).alias("c"))

    pieces = F.sort_array(F.collect_list(F.struct("c.kind", "c.i", "c.piece", "c.skip", "c.loss")))
    span_type = "struct<at:int,spans:array<struct<start:int,length:int>>>"
    marked = F.aggregate(
        "pieces",
        F.expr(f"cast(named_struct('at', 0, 'spans', array()) as {span_type})"),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["piece"])).alias("at"),
            F.when(
                p["loss"].isNotNull(),
                F.concat(a["spans"], F.array(F.struct((a["at"] + p["skip"]).alias("start"), p["loss"].alias("length")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return (
        dealt.groupBy("conv_id", F.col("c.window").alias("window"))
        .agg(pieces.alias("pieces"))
        .select(
            "conv_id",
            "window",
            F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
            marked["spans"].alias("loss_spans"),
            F.size(F.filter("pieces", lambda p: p["kind"] < 2)).alias("n_repeated"),
        )
    )


def parse_windows(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns``, the new turns read out of ``formatted``, and ``loss_text``."""
    written = F.split("formatted", r"<\|end\|>\n")
    new = F.slice(written, F.col("n_repeated") + 1, F.greatest(F.size(written) - 1 - F.col("n_repeated"), F.lit(0)))
    cut = lambda piece: F.instr(piece, "|>\n")
    return windows.withColumns(
        {
            "turns": F.transform(
                new,
                lambda p: F.struct(
                    unescape(F.substring(p, F.lit(3), cut(p) - 3)).alias("role"),
                    unescape(F.substring(p, cut(p) + 3, F.length(p))).alias("text"),
                ),
            ),
            "loss_text": F.array_join(
                F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), ""
            ),
        }
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation: digests of the turns and of the text under the loss mask, read from windows."""
    per_window = parse_windows(windows).select(
        "conv_id",
        F.struct(
            "window",
            F.size("turns").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            "loss_text",
        ).alias("w"),
        F.length("formatted").cast("long").alias("chars"),
    )
    ordered = per_window.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("w")).alias("ws"), F.sum("w.n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("ws", lambda w: w["loss_text"]), "")
    return ordered.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("ws", lambda w: w["turns"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one made of control strings, and read them back."""
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_windows(rows.unionByName(control)))


_ESCAPED = r"length(regexp_replace({0}, '[\\<\[|]', 'xx', 'g'))"
OP3_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM c
), p AS (
  SELECT *, i = 0 AND role = '{SYSTEM_ROLE}' AS is_system, (length(text) + 3) // 4 + 4 AS cost,
         {_ESCAPED.format("role")} + {_ESCAPED.format("text")} + 13 AS chars
  FROM o
), s AS (
  SELECT *, coalesce(sum(CASE WHEN is_system THEN 0 ELSE cost END)
                     OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         CASE WHEN is_system THEN 0 ELSE cost END AS tokens,
         greatest({BUDGET.least_new}, {BUDGET.window_tokens - BUDGET.history_tokens}
                  - max(CASE WHEN is_system THEN cost ELSE 0 END) OVER (PARTITION BY conv_id)) AS stretch,
         max(CASE WHEN is_system THEN chars END) OVER (PARTITION BY conv_id) AS system_chars
  FROM p
), w AS (
  SELECT *, 2 * (start // stretch) + ((start + greatest(tokens, 1) - 1) // stretch > start // stretch)::INT AS win FROM s
), f AS (
  SELECT *, win IS DISTINCT FROM lag(win) OVER (PARTITION BY conv_id ORDER BY i) AS first FROM w
), k AS (
  SELECT conv_id, sum(chars) AS chars FROM f GROUP BY conv_id
  UNION ALL SELECT conv_id, sum(system_chars) FROM f WHERE first AND i > 0 GROUP BY conv_id
  UNION ALL SELECT a.conv_id, sum(a.chars) FROM f a JOIN f b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
    AND b.first AND b.i > a.i AND b.i <= a.i + {BUDGET.history_turns} AND NOT a.is_system
    AND b.start - a.start <= {BUDGET.history_tokens} GROUP BY a.conv_id
), l AS (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM k GROUP BY conv_id
), t AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = '{TARGET_ROLE}'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{TARGET_ROLE}'), '')) AS loss_sha256
  FROM f GROUP BY conv_id
)
SELECT t.*, l.formatted_chars FROM t JOIN l ON t.conv_id IS NOT DISTINCT FROM l.conv_id
"""
