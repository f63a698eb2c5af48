"""Conversation repair against a search of all cheap edits, and its edge cases."""

import hashlib
import heapq
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from episodica.llm import repair
from episodica.sources.tables import table


def slow_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def slow_repair(rows):
    """Cost, least cheapest edits and repaired turns by best-first search over whole edit strings."""
    faults, todo = slow_faults(rows), [(0, "", 0, ())]
    while todo:
        cost, edits, at, out = heapq.heappop(todo)
        spelled = "".join(r[:1] or "-" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", spelled):
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", spelled):
            return cost, edits, out
        more = [("I", 2, 0, (role, "")) for role in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            more.append(("D", 3, 1, None))
            if faults[at] in ("", "truncated"):
                cut = faults[at] == "truncated"
                more += [("K", cut, 1, (role, text)), *[("R", 2 + cut, 1, (new, text)) for new in ("user", "assistant")]]
        for edit, price, step, turn in more:
            if cost + price <= 3 * len(rows):
                heapq.heappush(todo, (cost + price, edits + edit, at + step, (*out, turn) if turn else out))


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def slow_report(rows):
    rows = sorted_rows([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    turns = [t for t, _, _ in rows if t is not None]
    said = [(r, x) for _, r, x in rows]
    faults = slow_faults(said)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(said)]
    cost, edits, out = slow_repair(said)
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, digest


def random_conversations(rng, n):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?  ", "the same.", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "summary"]
    made = {}
    for conv in range(n):
        size = rng.randrange(7)
        made[conv] = [(rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for _ in range(size)]
        made[conv] += made[conv][: rng.randrange(2)]
    return {c: r for c, r in made.items() if r}


def test_repair_matches_search(spark):
    made = random_conversations(random.Random(3), 150)
    made[None] = [(0, "user", "Hello."), (1, "assistant", "Hi.")]
    made[900] = [(k, "assistant" if k % 2 else "user", f"turn {k}.") for k in range(40)]
    rows = [(c, *r) for c, many in made.items() for r in many]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(9), "digest": F.lit("x"), "audit": F.lit("y"), "first": F.lit(1)})
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(data.repartition(6)).collect()}
    assert got == {c: slow_report(many) for c, many in made.items()}
    turns = {}
    for r in repair.repaired(data).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for conv in made:
        said = sorted(turns.get(conv, []))
        assert [p for p, _, _ in said] == list(range(len(said)))
        assert hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in said).encode()).hexdigest() == got[conv][-1]


def test_damage(spark):
    """The five faults, by the CRC of a row's name, nulls as a space."""
    from zlib import crc32

    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(60), None) for r, x in [("assistant", "A. b! c?")]] + [(3, 5, None, None)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in repair.damaged(data).collect())


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(empty).count() == 0 and repair.repaired(empty).count() == 0
    ids = spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(map(str, repair.repair_report(empty, ids).collect())) == sorted(map(str, [repair.repair_report(empty, ids).where(c).first() for c in ("conv_id = 5", "conv_id is null")]))
    assert {tuple(r[1:]) for r in repair.repair_report(empty, ids).collect()} == {(0, 0, 0, 0, 0, 0, "", none)}
    long = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id", F.lit(".")).alias("text"))
    one = repair.repair_report(long.union(long)).collect()
    assert len(one) == 1 and one[0].duplicate == 3000 and one[0].cost == 9000 and one[0].audit == "KD" * 3000


@pytest.mark.parametrize("name", ["user,assistant", "system,user,assistant,user,assistant"])
def test_clean_conversations_stay(spark, name):
    roles = name.split(",")
    data = spark.createDataFrame([(7, k, r, f"said {k}.") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    row = repair.repair_report(data).first()
    assert (row.cost, row.audit) == (0, "K" * len(roles))
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:said {k}." for k, r in enumerate(roles)).encode()).hexdigest()


def test_table_of_conversations(spark, sf):
    rows = {}
    for r in repair.damaged(table(spark, sf, "conversations")).collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r[1:]) for r in repair.op13_conversation_repair(spark, sf).collect()}
    for conv, report in got.items():
        said = rows.get(conv, [])
        if len(said) < 9:
            assert report == (slow_report(said) if said else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
