"""Repair of conversation structure by the cheapest edits, computed once for every shared prefix.

A conversation is well formed if its roles' initials spell ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn. Edits go through its rows in order: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of
an empty user or assistant turn 2; a truncated row that stays adds 1; blank and duplicate rows must go. Among the
cheapest sequences of initials (``D``, ``I``, ``K``, ``R``) the least in ASCII is taken.

A row's part in this is one of 16 letters, of its role's initial and its first fault, and a conversation's is its
signature, the string of them. Distinct signatures are sorted over all partitions, so that a partition goes through
its part of the prefix trie in order: the layers of costs along the current path are kept on a stack, a signature
adds layers only beyond the prefix it shares with the one before, and answers are read off at its terminal node. An
edit and a state name the next state, so a cheapest sequence is read from layers without keeping strings in them.

No conversation is collected as a whole: rows are range-sorted, so that a long one lies in several tasks, each of which
sends its piece of the signature, a letter a row; equal rows are counted, first occurrences are minima of an
aggregation. The repaired text is made, and digested, in one pass over sorted rows behind their conversation's edits,
in memory of one signature and one batch. Only that digest, one value over all turns, needs a conversation in one task.

Rows come by turn, nulls first, ties by role and digest of the text; equal rows are adjacent turns, the later ones duplicates. Null
roles and texts read as one space, a role of another initial must be changed or go; a null conversation id is a
conversation. Conversations without rows, and those in which nothing is worth keeping, are repaired to none. An empty
table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.resampling import CRC_SQL, CRC_TABLE_SQL
from episodica.llm.shared import SPACE_CLASS, in_small_batches, written
from episodica.sources.tables import table

#: Initials and faults in the order of their numbers; a letter is ``A`` and four times the initial plus the fault.
INITIALS, FAULTS = ("s", "u", "a"), ("", "blank", "duplicate", "truncated")
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
RETURNED = ("blank", "duplicate", "truncated", "illegal", "cost")
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant. The next state by initial, and by a turn of our own.
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
OWN = {0: 2, 1: 2, 2: 3, 3: 2}
ACCEPTING = (0, 3)
NEVER = 1 << 60


def with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs of the states once turns may be inserted."""
    for _ in OWN:
        for state, then in OWN.items():
            costs[then] = min(costs[then], costs[state] + INSERT)
    return tuple(costs)


def moves(letter: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in ASCII order: initial, cost, next state."""
    initial, fault = divmod(letter, 4)
    yield "D", DELETE, state
    if fault in (1, 2):
        return
    stays = TRUNCATED if fault == 3 else 0
    if (state, initial) in NEXT:
        yield "K", stays, NEXT[state, initial]
    yield "R", REROLE + stays, OWN[state]


def layer_after(layer: tuple[int, ...], letter: int) -> tuple[int, ...]:
    """The next layer of costs."""
    costs = [NEVER] * 4
    for state, cost in enumerate(layer):
        for _, price, then in moves(letter, state):
            costs[then] = min(costs[then], cost + price)
    return with_inserts(costs)


START = with_inserts([0, NEVER, NEVER, NEVER])


def cheapest(letters: list[int], layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """Cost and least edits of a path whose layers are known."""
    cost = min(layers[-1][s] for s in ACCEPTING)
    marks = [set() for _ in layers]
    marks[-1] = {s for s in ACCEPTING if layers[-1][s] == cost}
    for i in range(len(letters), -1, -1):
        if i < len(letters):
            marks[i] = {s for s in range(4) if any(t in marks[i + 1] and layers[i][s] + p == layers[i + 1][t] for _, p, t in moves(letters[i], s))}
        for _ in OWN:
            marks[i] |= {s for s, t in OWN.items() if t in marks[i] and layers[i][s] + INSERT == layers[i][t]}
    i, state, edits = 0, 0, []
    while i < len(letters) or not (state in ACCEPTING and layers[-1][state] == cost):
        steps = [(e, i + 1, t) for e, p, t in moves(letters[i], state) if t in marks[i + 1] and layers[i][state] + p == layers[i + 1][t]] if i < len(letters) else []
        if OWN[state] in marks[i] and layers[i][state] + INSERT == layers[i][OWN[state]]:
            steps.append(("I", i, OWN[state]))
        edit, i, state = min(steps)
        edits.append(edit)
    return cost, "".join(edits)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of sorted signatures: a walk through their trie."""
    path: list[int] = []
    layers = [START]
    for batch in batches:
        out = []
        for signature in batch.column(0).to_pylist():
            letters = [c - 65 for c in signature.encode()]
            shared = 0
            for a, b in zip(path, letters, strict=False):
                if a != b:
                    break
                shared += 1
            del layers[shared + 1 :]
            for letter in letters[shared:]:
                layers.append(layer_after(layers[-1], letter))
            path = letters
            faults = [sum(c % 4 == f for c in letters) for f in (1, 2, 3)]
            illegal = sum((a // 4, b // 4) not in LEGAL_PAIRS for a, b in zip(letters, letters[1:], strict=False))
            cost, edits = cheapest(letters, layers)
            out.append((signature, *faults, illegal, cost, edits))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["signature", *RETURNED, "audit"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of a conversation's rows in this partition, with the letters of the run."""
    part, held, letters = TaskContext.get().partitionId(), None, []
    for batch in batches:
        done = []
        for conv_id, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if letters and conv_id != held:
                done.append((held, part, "".join(letters)))
                letters = []
            held = conv_id
            letters.append(piece)
        if done:
            yield _piece_batch(done, batch.schema.field(0).type)
        kind = batch.schema.field(0).type
    if letters:
        yield _piece_batch([(held, part, "".join(letters))], kind)


def _piece_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, parts, pieces = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(parts, pa.int32()), pa.array(pieces, pa.string())], names=["conv_id", "part", "piece"])


def _place() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("has_turn"), F.col("turn").alias("turn"))


def counted_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest, n``: equal rows once, with their number, as a table."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    counted = conversations.select("conv_id", "turn", space("role"), space("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    return written(counted.withColumn("digest", F.sha2("text", 256)), "turns")


#: The order of a conversation's rows.
ORDER = (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "digest")


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), *[rank(c) for rank, c in ORDER]]


def letters(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, letters``: a letter for each of the ``n`` turns of a row of ``counted_rows``."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    turns = rows.select("conv_id", "turn", "role", "digest", "n", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    firsts = turns.groupBy("conv_id", "role", "digest").agg(F.min(_place()).alias("first"), F.count("*").alias("times")).where("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("conv"), F.col("role").alias("said_by"), F.col("digest").alias("same"), "first")
    found = turns.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("said_by")) & (F.col("digest") == F.col("same")), "left")
    earlier = F.coalesce(F.col("first") != _place(), F.lit(False))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12) + 65
    own = F.when(F.col("blank"), 1).when(earlier, 2).when(F.col("cut"), 3).otherwise(0)
    later = F.when(F.col("blank"), 1).otherwise(2)
    spelled = F.concat(F.char(number + own), F.repeat(F.char(number + later), (F.col("n") - 1).cast("int")))
    return found.select("conv_id", "turn", "role", "digest", spelled.alias("letters"))


def signatures(rows: DataFrame) -> DataFrame:
    """``conv_id, signature`` of the conversations of ``counted_rows``."""
    kind = dict(rows.dtypes)["conv_id"]
    sorted_rows = letters(rows).repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv_id", "letters")
    pieces = sorted_rows.mapInArrow(_pieces, f"conv_id {kind}, part int, piece string")
    whole = F.sort_array(F.collect_list(F.struct("part", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(whole, lambda p: p["piece"]), "").alias("signature"))


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, blank, duplicate, truncated, illegal, cost, audit`` of the conversations of ``counted_rows``."""
    spelled = written(signatures(rows), "signatures")
    ordered = spelled.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    answers = ordered.mapInArrow(_answers, f"signature string, {', '.join(f'{c} bigint' for c in RETURNED)}, audit string")
    return spelled.join(written(answers, "audits"), "signature").drop("signature")


class _Turns:
    """Repaired turns of one conversation, as its rows come by."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, 0

    def _own(self, text: str) -> tuple[str, str, str]:
        self.state = OWN[self.state]
        return "user" if self.state == 2 else "assistant", text, self.edits[self.at - 1]

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        """Turns inserted before the next row, or at the end."""
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield self._own("")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Role, text and edit of what a row and the turns before it become."""
        yield from self.inserts()
        self.at += 1
        edit = self.edits[self.at - 1]
        if edit == "K":
            self.state = NEXT[self.state, INITIALS.index(role[:1])]
            yield role, text, edit
        elif edit == "R":
            yield self._own(text)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, object]]:
    """Heads of conversations, their repaired turns and their ends, from sorted rows behind their heads."""
    turns = None
    for batch in batches:
        is_row, role, text, n = (batch.column(k).to_pylist() for k in range(4))
        for k in range(batch.num_rows):
            if not is_row[k]:
                if turns:
                    yield from (("turn", t) for t in turns.inserts())
                    yield "end", None
                turns = _Turns(text[k])
                yield "head", batch.slice(k, 1)
                continue
            for _ in range(n[k]):
                yield from (("turn", t) for t in turns.row(role[k], text[k]))
    if turns:
        yield from (("turn", t) for t in turns.inserts())
        yield "end", None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head = digest = None
    for what, value in _replayed(batches):
        if what == "head":
            head, digest, between = value, hashlib.sha256(), ""
        elif what == "turn":
            digest.update(f"{between}{value[0]}:{value[1]}".encode())
            between = "\n"
        else:
            yield pa.RecordBatch.from_arrays([*head.columns[4:], head.column(2), pa.array([digest.hexdigest()])], names=[*head.schema.names[4:], "audit", "repaired_sha256"])


def _repaired_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(head: pa.RecordBatch, turns: list[tuple], at: int) -> pa.RecordBatch:
        ids = pa.array([head.column(4)[0].as_py()] * len(turns), head.schema.field(4).type)
        return pa.RecordBatch.from_arrays([ids, pa.array(range(at, at + len(turns)), pa.int64()), *map(pa.array, zip(*turns, strict=True))], names=["conv_id", "place", "role", "text", "edit"])

    head, turns, at = None, [], 0
    for what, value in _replayed(batches):
        if what == "head":
            head, turns, at = value, [], 0
        elif what == "turn":
            turns.append(value)
        if turns and (what == "end" or len(turns) == ROWS):
            yield batch(head, turns, at)
            at, turns = at + len(turns), []


#: Repaired turns that leave a task at once.
ROWS = 250


def _behind_heads(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """``is_row, role, text, n, conv_id`` and the other columns of ``heads``: rows behind their conversation's edits."""
    empty = F.lit("").alias("role")
    others = [c for c in heads.columns if c not in ("conv_id", "audit")]
    first = heads.select(F.lit(0).alias("is_row"), empty, F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"), "conv_id", *others, F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("digest"))
    nothing = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in others]
    behind = rows.select(F.lit(1).alias("is_row"), "role", "text", "n", "conv_id", *nothing, "turn", "digest")
    dealt = first.unionByName(behind).repartition("conv_id")
    return in_small_batches(dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), "is_row", *_order()[1:]).drop("turn", "digest"))


def repaired(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, edit``: the turns of every repaired conversation, in order of ``place``."""
    rows = counted_rows(conversations)
    kind = dict(rows.dtypes)["conv_id"]
    return _behind_heads(audits(rows).select("conv_id", "audit"), rows).mapInArrow(_repaired_turns, f"conv_id {kind}, place bigint, role string, text string, edit string")


def repair_report(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps``, the columns of ``audits`` and ``repaired_sha256`` of every conversation.

    Conversations of ``every``, a DataFrame with ``conv_id``, that have no rows get zeros and empty repairs.
    """
    rows = counted_rows(conversations)
    spread = F.max("turn") - F.min("turn") + 1
    distinct_turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id")
    gaps = distinct_turns.agg(F.coalesce(spread - F.count("turn"), F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv_id", "conv")
    heads = audits(rows).join(gaps, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    if every is not None:
        ids = every.select(F.col("conv_id").alias("conv")).distinct()
        heads = ids.join(heads, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv_id").withColumnRenamed("conv", "conv_id")
    heads = heads.na.fill(0, ["gaps", *RETURNED]).na.fill("", ["audit"]).select("conv_id", "gaps", *RETURNED, "audit")
    kind = dict(heads.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps bigint, {', '.join(f'{c} bigint' for c in RETURNED)}, audit string, repaired_sha256 string"
    return _behind_heads(heads, rows).mapInArrow(_digests, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults: by the CRC of a row's name it is lost, emptied, cut, repeated or given to the user."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.col("kind")
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(name) % 20).alias("kind")).where("kind <> 0")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation after damage."""
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations).select("conv_id", "gaps", *RETURNED, "audit", "repaired_sha256")


def _sql_closed(costs: str) -> str:
    """SQL of four (cost, edits) after inserts, from the columns ``{costs}0`` to ``{costs}3``."""
    add = lambda s, n: f"{{'c': {costs}{s}.c + {2 * n}, 'e': {costs}{s}.e || '{'I' * n}'}}"
    two = f"list_min([{costs}2, {add(0, 1)}, {add(1, 1)}, {add(3, 1)}])"
    three = f"list_min([{costs}3, {add(2, 1)}, {add(0, 2)}, {add(1, 2)}])"
    return f"{costs}0 AS f0, {costs}1 AS f1, {two} AS f2, {three} AS f3"


def _sql_step() -> str:
    """SQL of four (cost, edits) after a row, from ``f0`` to ``f3``: delete, or keep or change where allowed."""
    gone = lambda k: f"{{'c': f{k}.c + 3, 'e': f{k}.e || 'D'}}"
    kept = lambda k, i: f"{{'c': f{k}.c + CASE WHEN fault IN ('', 'truncated') AND i = '{i}' THEN (fault <> '')::INT ELSE 999999 END, 'e': f{k}.e || 'K'}}"
    own = lambda k: f"{{'c': f{k}.c + CASE WHEN fault IN ('', 'truncated') THEN 2 + (fault <> '')::INT ELSE 999999 END, 'e': f{k}.e || 'R'}}"
    return ", ".join(
        [
            f"{gone(0)} AS g0",
            f"list_min([{gone(1)}, {kept(0, 's')}]) AS g1",
            f"list_min([{gone(2)}, {', '.join(kept(k, 'u') + ', ' + own(k) for k in (0, 1, 3))}]) AS g2",
            f"list_min([{gone(3)}, {kept(2, 'a')}, {own(2)}]) AS g3",
        ]
    )


_BEGIN = ", ".join(f"{{'c': {0 if k == 0 else 999999}, 'e': ''}} AS g{k}" for k in range(4))
OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL}, named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s
  FROM conversations
), kinds AS (SELECT *, ({CRC_SQL} % 20)::BIGINT AS kind FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)
), ranked AS (
  SELECT cid, turn, role, text, substr(role, 1, 1) AS i,
         row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS k
  FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{SPACE_CLASS}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][{SPACE_CLASS}]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY cid ORDER BY k) || i AS pair
  FROM ranked
), begun AS (SELECT cid, 0::BIGINT AS k, {_BEGIN} FROM ids
), dp AS (
  SELECT cid, k, {_sql_closed("g")} FROM begun
  UNION ALL
  SELECT cid, k, {_sql_closed("g")} FROM (SELECT r.cid, r.k, {_sql_step()} FROM dp JOIN r ON r.cid = dp.cid AND r.k = dp.k + 1)
), best AS (
  SELECT cid, list_min([f0, f3]) AS b FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY k DESC) AS last FROM dp) WHERE last = 1
), edits AS (
  SELECT cid, j, b.e[j] AS edit FROM (SELECT cid, b, unnest(range(1, length(b.e) + 1)) AS j FROM best)
), marked AS (
  SELECT cid, j, edit, count(*) FILTER (edit <> 'I') OVER w AS k, count(*) FILTER (edit <> 'D') OVER w AS place
  FROM edits WINDOW w AS (PARTITION BY cid ORDER BY j)
), placed AS (
  SELECT m.cid, j, edit, place, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
         max((place = 1 AND edit = 'K' AND i = 's')::INT) OVER (PARTITION BY m.cid) AS has_system
  FROM marked m LEFT JOIN r ON r.cid = m.cid AND r.k = m.k WHERE edit <> 'D'
), said AS (
  SELECT cid, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS said
  FROM placed GROUP BY cid
), counts AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY cid
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.e AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ids JOIN best USING (cid) LEFT JOIN counts USING (cid) LEFT JOIN said USING (cid)
"""
