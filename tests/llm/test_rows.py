"""Operators that work within rows or conversations: quality, licences, html, chat; and edge cases of all."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from episodica.llm import chat, decontaminate, html, licenses, quality, queries
from episodica.sources.tables import table

TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]


def sql_rows(sf, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con.execute(sql).df()


def text_rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), sql_rows(sf, queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_int = lambda df: df.assign(**{c: df[c].astype("Int64") for c in columns if c in ("refers_to", "rank")})
    assert text_rows(as_int(got), columns) == text_rows(as_int(want), columns)


def slow_repeats(words):
    counts = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if counts[tuple(words[i : i + 5])] > 1 for k in range(5)})


def test_quality_measures():
    rng = random.Random(0)
    for _ in range(200):
        words = [rng.choice("abc").encode() for _ in range(rng.randrange(40))]
        assert quality.repeated_words(words) == slow_repeats(words)
    assert quality.measure(None) == quality.measure("") == (0, 0, 0, 0, 0)
    assert quality.measure("é x #\n\n a\n a\n\x1c") == (5, 7, 1, 1, 0)


def test_quality_ledger_and_ablation(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(1, good, 5), (2, "short", 6), (3, None, 7), (4, good + " ###" * 30, 8), (4, "x y " * 30, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    entries = quality.ledger(docs)
    assert entries.columns == ["doc_id", *quality.MEASURES, "failed"]
    found = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality.ablation(entries).collect()}
    assert found == {"few_words": (2, 2), "repeated_windows": (2, 1), "many_symbols": (1, 0)}
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[0]]
    assert quality.ledger(docs.limit(0)).count() == 0


def test_licences(spark):
    apache = (
        "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance\nwith the License.\n"
        "You may obtain a copy of the License at:\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law"
    )
    rows = [
        (1, "Some text\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
        (2, apache, "Apache-2.0"),
        (3, "Released under the MIT License. This work is licensed under the GNU General Public License, version 3!", "GPL-3.0-only,MIT"),
        (4, "We released under the MIT license nothing.", ""),
        (5, None, ""),
        (6, "", ""),
        (7, "SPDX-License-Identifier: MIT\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
        (7, "x " * 50_000 + ".\nMIT License\n", ""),  # a title alone is no licence
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = licenses.scan(docs.withColumnRenamed("licences", "want")).select("want", F.array_join("licences", ",")).collect()
    assert len(got) == 8
    for want, found in got:
        assert want == found
    assert licenses.scan(docs.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{x:y}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept them all now and for ever.</div>
%s
<aside>See also this other text of ours, it is long enough to look like content.</aside>
<form><label>Search</label><input name=q><button>Go</button></form>
<footer>&copy; 2024 all rights reserved</footer></body></html>"""
BODY = """<h1>A &amp; B</h1><p>First
  paragraph<br>of   the article, which goes on for a while so that there is some text in it.
<p>Short.<script>var x = "</p>";</script><ul><li>one<li>two</ul><blockquote>Quoted &lt;b&gt; text</blockquote>
<div class="ad">Buy this now and save a lot of money on things that you do not need.</div>
<p>Last &#233;nd.</p>"""
WANT = "A & B\n\nFirst paragraph of the article, which goes on for a while so that there is some text in it.\n\nShort.\n\none\n\ntwo\n\nQuoted <b> text\n\nLast énd."


@pytest.mark.parametrize("around", ["<article>%s<section class='comments'><p>I liked it a lot, it was very good to read.</p></section></article>", "<main>%s</main>", "<div id=content>%s</div>", "<article>%s"])
def test_main_text(around):
    assert html.extract(PAGE % (around % BODY)) == WANT


def test_main_text_edge_cases(spark):
    rows = [(1, None, "u", "old"), (2, "", None, "old"), (3, "plain &amp; simple", "u", "old"), (3, "<p>" * 3000 + "deep", "u", "old"), (4, "<nav>only a menu</nav>", "u", "old"), (5, "<div" * 50, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = sorted((r.page_id, r.text) for r in html.main_text(pages).collect())
    assert got[:5] == [(1, ""), (2, ""), (3, "deep"), (3, "plain & simple"), (4, "")]
    assert html.main_text(pages.limit(0)).count() == 0
    big = "<article>" + "<p>para graph</p>" * 20_000 + "</article>"
    assert html.extract(big).count("\n\n") == 19_999


def test_pages_match_their_articles(spark, sf):
    """The pages' articles, cut out by their known template."""
    import html as entities
    import re

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(h1|p)>", "\0", inner))).split("\0")
        return "\n\n".join(t for t in (" ".join(entities.unescape(b).split()) for b in blocks) if t)

    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in html.main_text(table(spark, sf, "pages")).collect():
        assert r.text == article(pages[r.page_id])


def slow_chat(turns):
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_windows(spark):
    rng = random.Random(5)
    alphabet = ["a", "é", "\\", "<", "|", "[", "]", ">", "\n", "<|end|>\n", "[INST]", "</s>", "|>\n", " word", "\\\\", "<\\"]
    rows, by_conv = [], {}
    for conv in range(40):
        turns = [("system", "be nice")] if conv % 3 == 0 else []
        for _ in range(rng.randrange(0 if turns else 1, 30)):
            turns.append((rng.choice(["user", "assistant", "to<|ol"]), "".join(rng.choice(alphabet) for _ in range(rng.randrange(200)))))
        by_conv[conv] = turns
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (None, 0, "user", "x" * 20_000), (None, 1, "assistant", "y" * 20_000)]
    by_conv |= {100: [("", ""), ("assistant", "")], None: [("user", "x" * 20_000), ("assistant", "y" * 20_000)]}
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(5)
    budget = chat.Budget(120, 30, 2, 16)
    windows = chat.format_windows(data, budget).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == {c: slow_chat(t) for c, t in by_conv.items()}
    for w in chat.parse_windows(windows).collect():
        pieces = w.formatted.split(chat.END)[:-1]
        texts = [p.split("|>\n", 1)[1] for p in pieces]
        tokens = [(len(t) + 3) // 4 + 4 for t in texts]
        new = tokens[w.n_repeated :]
        assert w.n_repeated <= budget.history_turns + 1 and w.n_repeated + len(w.turns) == len(pieces)
        assert len(new) == 1 or sum((len(t.text) + 3) // 4 + 4 for t in w.turns if t.role != "system") <= budget.window_tokens - budget.history_tokens
        for control in ("[INST]", "</s>"):
            assert control not in w.formatted
    assert chat.read_back(chat.format_windows(data.limit(0))).count() == 0


@pytest.mark.parametrize("given, sizes", [(None, [6]), (1, [6]), (70, [1] * 6), (30, [3, 3]), (-5, [6])])
def test_chat_windows_by_given_tokens(spark, given, sizes):
    """Spans are cut by the tokens of a column, and by the estimate where it is null."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k}", given) for k in range(6)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    windows = chat.format_windows(data, chat.Budget(120, 30, 0, 16), "n")
    assert [len(w.turns) for w in chat.parse_windows(windows).orderBy("window").collect()] == sizes
    assert [tuple(r)[1:5] for r in chat.read_back(windows).collect()] == [slow_chat([r[2:4] for r in rows])]


def test_decontamination_edge_cases(spark):
    item = " ".join(f"item{k}" for k in range(30))
    changed = item.replace("item29", "other")
    far = item.replace("item5 ", "x ").replace("item12 ", "y ").replace("item20 ", "z ")
    rows = [
        (1, f"before {item.upper()} after"),
        (2, changed),
        (3, far),
        (4, None),
        (5, ""),
        (6, "tiny item"),
        (7, "nothing of it " * 2000),
        (8, item),
        (8, item),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(1), "start": F.lit(2)})
    bench = spark.createDataFrame([(10, item), (10, item), (11, "tiny item"), (12, None), (13, ""), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 10), (2, 10), (8, 10), (6, 11), (1, None), (2, None), (8, None)}
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_benchmark_in_blocks(spark, sf, monkeypatch):
    rows = lambda: sorted(map(str, decontaminate.op5_decontamination(spark, sf).collect()))
    whole = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 300)
    assert rows() == whole
    monkeypatch.setattr(decontaminate, "BROADCAST_STARTS", 1)
    assert rows() == whole


def slow_windows(docs, items):
    """The best of all windows, at every start, by brute force."""
    from collections import Counter

    found = {}
    for doc_id, text in docs:
        words = (text or "").lower().split()
        for item_id, item in items:
            goal = item.lower().split()
            width, size = min(5, len(goal)), min(len(words), len(goal))
            count = lambda w: Counter(zip(*(w[k:] for k in range(width)), strict=False))  # noqa: B023, E731
            want, best = count(goal), None
            for start in range(len(words) - size + 1):
                got = count(words[start : start + size])
                value = (got & want).total() / max(1, (got | want).total())
                if value >= 0.8 and (best is None or value > best[0]):
                    best = (value, start)
            if best:
                found[doc_id, item_id] = best
    return found


def test_decontamination_of_all_windows(spark):
    """Items with halves swapped, words put in, taken out or changed, and repetitive ones, at any place."""
    import random

    rng = random.Random(11)
    items, docs = [], []
    for k in range(30):
        n = rng.choice([3, 6, 20, 40, 100])
        items.append((k, " ".join(rng.choice(["ab", f"w{rng.randrange(9 if k % 3 == 0 else 900)}"]) for _ in range(n))))
    for d in range(160):
        words = rng.choice(items)[1].split()
        kind, at = d % 5, rng.randrange(len(words))
        if kind == 0:
            words = words[at:] + words[:at]
        elif kind == 1:
            words.insert(at, "put")
        elif kind == 2:
            del words[at]
        elif kind == 3:
            words[at] = "other"
        around = [[f"r{rng.randrange(50)}" for _ in range(rng.randrange(30))] for _ in (0, 1)]
        docs.append((d, " ".join([*around[0], *words, *around[1]])))
    docs += [(900, "ab " * 700), (901, "w1 ab " * 300), (902, None), (903, "")]
    items += [(40, "ab " * 60), (41, "ab w1 " * 25)]
    want = slow_windows(docs, items)
    made = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(*made).collect()}
    assert {*got} == {*want} and len(want) > 60
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_decontamination_of_uneven_counts(spark):
    """Few different shingles, in other proportions than the item's: their fingerprints differ in many bits."""
    rng = random.Random(6)
    some = lambda counts: " ".join(w for w, n in counts for _ in range(n))
    items, docs = [(0, some([("x", 26), ("y", 22)]))], [(0, some([("x", 22), ("y", 26)]))]
    for k in range(1, 60):
        letters = rng.sample("abcdefgh", rng.choice([2, 3]))
        counts = [(w, rng.randrange(5, 40)) for w in letters]
        items.append((k, some(counts)))
        docs.append((k, some([(w, max(1, n + rng.randrange(-6, 7))) for w, n in counts])))
    data = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"__hit": F.lit(1), "start": F.lit(2), "window": F.lit(3)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow_windows(docs, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(data, bench).collect()}
    assert abs(want[0, 0][0] - 40 / 48) < 1e-9 and len(want) > 30
    assert {*got} == {*want} and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    kept = decontaminate.decontaminated(data, bench)
    assert kept.columns == data.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    con = duckdb.connect()
    for name, rows, columns in (("documents", docs, "doc_id BIGINT"), ("benchmark", items, "item_id BIGINT")):
        con.execute(f"CREATE TABLE {name} ({columns}, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert {(d, i): (v, s) for d, i, v, s in con.execute(decontaminate.OP5_SQL).fetchall()}.keys() == want.keys()
