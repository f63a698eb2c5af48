"""SimHash: fingerprints, bit-sliced comparison and components against brute force."""

import numpy as np
import pytest
import xxhash

from episodica.llm import simhash
from episodica.sources.tables import table


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Smallest index reachable over distances of at most 3, by brute force over all pairs."""
    values = np.array(prints, np.uint64)
    label = np.arange(len(values))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 3) for v in values]
    changed = True
    while changed:
        changed = False
        for n in near:
            least = label[n].min()
            if (label[n] != least).any():
                label[n] = least
                changed = True
    return label


def test_documents_match_brute_force(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    prints = [slow_fingerprint(t) for _, t in rows]
    label = slow_components(prints)
    expected = [(d, f"{p:016x}", rows[k][0]) for (d, _), p, k in zip(rows, prints, label, strict=True)]
    assert sorted(tuple(r) for r in simhash.op6_simhash_components(spark, sf).collect()) == expected


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 7])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    values = np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6), dtype=np.uint64)) for c in centres for _ in range(25)])
    i, j = simhash.close_in_block(values, values, radius)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(near)), strict=True)}
    group = np.repeat(np.arange(12), 25)
    i, j = simhash.close_in_small_groups(values, group, radius)
    inside = near & (group[:, None] == group[None, :]) & (np.arange(300)[:, None] < np.arange(300)[None, :])
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(inside)), strict=True)}


def test_links_over_large_files(spark, monkeypatch):
    """Chains and hot files that are cut into tiles lose no link."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(7)
    values = {int(x) for x in rng.integers(0, 2**63, 50)}
    for start in (5, 2**40 + 3):
        walk = start
        for _ in range(200):
            walk ^= 1 << int(rng.integers(0, 62))
            values.add(walk)
    values = sorted(values)
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.u: r.root for r in simhash.component_roots(simhash.fingerprint_links(prints)).collect()}
    label = slow_components(values)
    assert [roots.get(v, v) for v in values] == [values[k] for k in label]


@pytest.mark.parametrize("radius", [1, 6, 9])
def test_other_radii(spark, radius):
    """Fingerprints at the radius are linked, those one bit beyond it are not."""
    rng = np.random.default_rng(radius)
    values = []
    for _ in range(40):
        base = int(rng.integers(0, 2**63))
        bits = rng.permutation(63)
        near = base ^ sum(1 << int(b) for b in bits[:radius])
        far = near ^ sum(1 << int(b) for b in bits[radius : 2 * radius + 1])
        values += [base, near, far]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.u: r.root for r in simhash.component_roots(simhash.fingerprint_links(prints, radius)).collect()}
    root = [roots.get(v, v) for v in values]
    assert all(root[k] == root[k + 1] != root[k + 2] for k in range(0, len(root), 3))


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "one", 3), (4, "ONE", 4), (4, "ONE", 4), (None, "x y", 5), (9, "a b c " * 9000, 6), (8, "a b c " * 9000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (None, None), (9, 8), (8, 8)}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 8), (True, 0)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
