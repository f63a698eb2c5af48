"""The pipeline's stages and its result against brute-force versions of every stage."""

import hashlib
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from episodica.llm import decontaminate, mixing, quality, token_ids
from episodica.llm.shared import written
from episodica.sources.tables import table

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_near_copies import slow_kept  # noqa: E402


def slow_quality(rows):
    out = []
    for r in rows:
        n, _, symbols, _, repeats = quality.measure(r["text"])
        if not (n < 10 or 100 * repeats > 20 * n or 5 * symbols > n):
            out.append(r)
    return out


def slow_dedup(rows):
    """The first document of every component of texts with a five-word similarity of 0.8 or more."""
    kept = {*slow_kept([(r["doc_id"], r["text"]) for r in rows])}
    return [r for r in rows if r["doc_id"] in kept]


def shingles(words):
    return Counter(zip(*(words[k:] for k in range(5)), strict=False))


def slow_decontaminate(rows, items):
    parts = [i.lower().split() for i in items]
    out = []
    for r in rows:
        words = (r["text"] or "").lower().split()
        own = shingles(words)
        hit = False
        for item in parts:
            want = shingles(item)
            if not own & want:
                continue
            for start in range(max(1, len(words) - len(item) + 1)):
                got = shingles(words[start : start + len(item)])
                if sum((got & want).values()) >= 0.8 * sum((got | want).values()):
                    hit = True
        if not hit:
            out.append(r)
    return out


def slow_mix(rows):
    n_words = lambda r: len((r["text"] or "").encode().split())
    sources = sorted({r["source"] for r in rows})
    size = {s: sum(n_words(r) for r in rows if r["source"] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    left, budget, target = set(sources), 1.5 * sum(size.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        capped = {s for s in left if level * weight[s] > 2 * size[s]}
        if not capped:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 2.0 * size[s] for s in capped}
        budget -= sum(2 * size[s] for s in capped)
        left -= capped
    key = lambda r: int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:15], 16)
    out = []
    for s in sources:
        queue, at = sorted((r for r in rows if r["source"] == s), key=key), 0
        for r in queue * 2:
            take = max(0, min(n_words(r), int(target[s] + 1e-6) - at))
            at += n_words(r)
            if take:
                out.append((r, take))
    return out


def test_result_matches_brute_force(spark, sf):
    docs = [r.asDict() for r in table(spark, sf, "documents").collect()]
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    rows = slow_decontaminate(slow_dedup(slow_quality(docs)), items)
    served = slow_mix(rows)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_ids.default_tokenizer())
    expected = Counter()
    for r, take in served:
        text = " ".join(r["text"].encode().split()[k].decode() for k in range(take))
        ids = tok.encode(text, add_special_tokens=False).ids + [token_ids.END_ID]
        expected[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_stages_keep_the_columns_and_survive_empty_tables(spark, sf):
    docs = table(spark, sf, "documents")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).columns == docs.columns, name
        assert stage(spark, empty, sf).count() == 0
    assert corpus_pipeline.token_output(spark, empty, sf).count() == 0


def test_stages_take_nulls_and_repeated_rows(spark, sf):
    long = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(40))
    rows = [(1, long, "en", "a", 5, "x"), (1, long, "en", "a", 5, "x"), (2, None, None, None, None, None), (3, other, "en", None, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "stage-test")
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {1, 3}
    assert corpus_pipeline.token_output(spark, docs, sf).count() == docs.count()
    assert decontaminate.contaminated(docs, docs.select(docs.doc_id.alias("item_id"), "text")).count() >= 1
