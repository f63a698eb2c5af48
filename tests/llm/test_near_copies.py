"""The pipeline's near-deduplication against all pairs by brute force."""

import random
import sys

import pytest

from episodica.llm import decontaminate, simhash
from episodica.sources.tables import table

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    words = (text or "").lower().split()
    return {*zip(*(words[k:] for k in range(5)), strict=False)} if len(words) >= 5 else {tuple(words)}


def slow_kept(rows):
    """Ids of the first document of every component of texts at a similarity of 0.8 or more."""
    rows = sorted(rows)
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted(rows[k][0] for k in {*label})


def stage(spark, docs):
    return corpus_pipeline.near_deduplication(spark, docs, "")


def test_near_copies_go_and_others_stay(spark):
    """Copies with a few changed words are far apart in fingerprints, but similar."""
    rng = random.Random(3)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 120, 400]))]
        for c, changes in enumerate((0, 1, 1, 2, 3, 5)):
            copy = list(words)
            for _ in range(changes * len(words) // 100 + (changes > 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            rows.append((100 * k + c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in stage(spark, docs).collect()) == slow_kept(rows)


def test_rows_are_kept_by_row_not_by_id(spark):
    """Rows without an id, or with one id, are separate documents in every stage."""
    words = {k: " ".join(f"{k}{n}" for n in range(40)) for k in "abcdei"}
    rows = [(1, "a", 1), (2, "a", 2), (2, "b", 3), (3, "c", 4), (3, "d", 5), (None, "e", 6), (None, "a", 7), (None, "c", 8), (None, "d", None), (None, "e", 6)]
    docs = spark.createDataFrame([(d, words[t], n) for d, t, n in rows], "doc_id long, text string, n long")
    want = [(1, "a", 1), (2, "b", 3), (3, "c", 4), (3, "d", 5), (None, "e", 6)]
    for kept in (stage(spark, docs), simhash.deduplicated(docs)):
        assert kept.columns == docs.columns
        assert {*map(tuple, kept.collect())} == {(d, words[t], n) for d, t, n in want} and kept.count() == 5
    items = spark.createDataFrame([(1, words["a"]), (2, words["c"])], "item_id long, text string")
    clean = decontaminate.decontaminated(docs.unionByName(docs.limit(1).selectExpr("doc_id", "string(null) AS text", "n")), items)
    assert sorted(((r.text or "")[:1], r.n or 0) for r in clean.collect()) == [("", 1), ("b", 3), ("d", 0), ("d", 5), ("e", 6), ("e", 6)]


def test_documents_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in stage(spark, table(spark, sf, "documents")).collect())
    assert got == slow_kept(rows)


def test_large_components_in_tiles(spark, monkeypatch):
    """Hundreds of near copies of one text, in tiles of a few texts, leave one; a text at 0.7 stays."""
    from episodica.llm import near_copies

    monkeypatch.setattr(near_copies, "TILE", 16)
    monkeypatch.setattr(simhash, "TILE", 16)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(150):
        copy = list(words)
        copy[k] = f"x{k}"
        rows.append((k, " ".join(copy)))
    apart = list(words)
    for k in range(10, 200, 30):
        apart[k] = f"y{k}"
    rows.append((1000, " ".join(apart)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in stage(spark, docs).collect()) == slow_kept(rows) == [0, 1000]


def test_connected_pairs_match_all_pairs():
    """Left-out comparisons change no component."""
    import numpy as np

    from episodica.llm import near_copies

    rng = np.random.default_rng(5)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(100) < 0.06, rng.integers(1000, 9000, 100), base).astype(np.uint64)) for _ in range(60)]
    every = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    found = near_copies.connected([*range(60)], [*range(60)], sets, np.ones((60, 60), bool))

    def labels(pairs):
        label = list(range(60))
        for i, j in pairs:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
        return label

    assert labels(found) == labels(every) and len(found) < len(every) and {*map(frozenset, found)} <= {*map(frozenset, every)}
