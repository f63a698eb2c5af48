"""Repeated 100-byte strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from episodica.llm import suffix_dedup
from episodica.sources.tables import table


def slow(rows):
    """Digests by a dictionary of every 100-byte string; rows in order of what is earlier."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_documents_match_brute_force(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    assert sorted((tuple(r) for r in suffix_dedup.op1_suffix_dedup(spark, sf).collect()), key=str) == slow(rows)


def made_rows():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    line = "".join(rng.choice("xyz ") for _ in range(110))
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 300), (4, "ab" * 200), (5, passage)]
    for k in range(6, 60):
        noise = lambda: "".join(rng.choice("klmnopqé") for _ in range(rng.randrange(150)))
        a = rng.randrange(100)
        rows.append((k, noise() + passage[a : a + rng.randrange(90, 200)] + noise() + line * rng.randrange(3) + noise()))
    return [*rows, (60, rows[20][1]), (61, rows[20][1] + "tail"), (62, passage * 3)]


@pytest.mark.parametrize("piece", [1, 150, 1000])
def test_pieces_give_the_same_samples(monkeypatch, piece):
    """Every string of a text has the same sample however the text is cut."""
    text = "".join(t or "" for _, t in made_rows())[:5000]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["k", "text"])

    def strings():
        found = {}
        for out in suffix_dedup._sample_batches(iter([batch])):
            for name, place in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                for k in range(place >> 8 & 255):
                    found[(place >> 16) + k] = (name, (place >> 16) + (place & 255))
        return found

    whole = strings()
    assert sorted(whole) == list(range(len(text.encode()) - 99))
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    assert strings() == whole


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_made_texts(spark, monkeypatch, hot):
    """Periodic texts, overlaps, copies; hot names are salted."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in suffix_dedup.removal_digests(docs).collect()), key=str) == slow(rows)


def test_repeated_ids_nulls_and_empty_table(spark):
    long = "the quick brown fox jumps over the lazy dog " * 4
    rows = [(None, long), (1, long), (1, long), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.removal_digests(docs).collect()), key=str)
    first = slow([(0, long)])[0][2]
    assert got == sorted([(None, first), (1, len(long)), (1, len(long)), (2, 0)], key=str)
    assert suffix_dedup.removal_digests(docs.limit(0)).collect() == []
    wide = docs.withColumns({"spans": docs.doc_id, "runs": docs.doc_id})
    assert suffix_dedup.removal_digests(wide).count() == 4
    assert suffix_dedup.with_spans(wide).columns == ["doc_id", "text", "runs", "spans"]
    assert suffix_dedup.with_spans(wide).count() == 4


def test_names_that_clash(monkeypatch):
    """Strings of one name and different bytes are told apart."""
    real = suffix_dedup.string_names
    monkeypatch.setattr(suffix_dedup, "string_names", lambda data, at: real(data, at) & np.uint64(7))
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 123, 150, dtype=np.uint8).tobytes().decode() for _ in range(6)]
    texts = ["".join(parts[k] for k in rng.integers(0, 6, rng.integers(1, 5))) for _ in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    _, at, _, repeats = suffix_dedup.mark_repeats(data, offsets, np.zeros(len(texts), np.uint64))
    seen, want = set(), []
    for k in at.tolist():
        string = data[k : k + 100].tobytes()
        want.append(string in seen)
        seen.add(string)
    assert repeats.tolist() == want
