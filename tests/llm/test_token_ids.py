"""Token ids: exact round trip against the tokenizer itself, packing, random access, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import files, token_ids
from episodica.sources.tables import table

HARD = ["a<|endoftext|>b <|startoftext|> x", "it's I'll x\x1cy ΣΑΣ é ́z", "", None, "w" * 5000, "  \n\t ", "one two one", "one two one"]


def expected(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_ids.default_tokenizer())
    out, start = [], 0
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [token_ids.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_match_the_tokenizer(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    got = sorted(tuple(r) for r in token_ids.op10_token_ids(spark, sf).collect())
    assert got == expected(rows)


def test_hard_texts_nulls_and_empty_table(spark):
    rows = list(enumerate(HARD))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    assert sorted(tuple(r) for r in token_ids.token_digests(docs).collect()) == expected(rows)
    assert token_ids.token_digests(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = token_ids.token_digests(twice).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 4096)
    assert (token_ids.unpack(token_ids.pack(ids, bits), bits) == ids).all()
    lanes = ((ids[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
    assert token_ids.pack(ids, bits) == np.packbits(lanes.ravel(), bitorder="little").tobytes()


def test_random_access(spark, sf):
    from episodica.llm.shared import fresh_path

    path = fresh_path(spark, "ids-test")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    token_ids.write_token_ids(docs, path, token_ids.default_tokenizer())
    read = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in token_ids.read_token_ids(spark, path).collect()}
    store, folder = files.open_store(path)
    for entry in files.read_manifest(path)["shards"]:
        shard = token_ids.Shard(store, f"{folder}/{entry['name']}")
        for k in range(0, shard.n_docs, 7):
            assert (shard.document(k) == read[int(shard.doc_ids[k])]).all()


def test_words_of_all_alphabets():
    """The memo of words against the tokenizer on whole texts of random characters."""
    import random

    rng = random.Random(1)
    pool = [chr(c) for c in (*range(32, 0x530), 0x1E9E, 0x149, 0x1F0, 0x4E2D, 0x1D400, 0xFB01, 0xFB1D, 0xA0, 0x2028, 0x85, 0x1C, 0x212A, 0x212B)]
    ends = ["", ".", ",", "!!", "'s", "%%%", "...", "'", "|"]
    words = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) + rng.choice(ends) for _ in range(20_000)]
    texts = [" ".join(words[k : k + 20]) for k in range(0, len(words), 20)]
    encoder = token_ids.WordEncoder(token_ids.default_tokenizer(), 2, token_ids.END_ID)
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.array([*e.ids, token_ids.END_ID], "<u2").tobytes() for e in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_tokenizer_file(name):
    """Whole texts by the library, whatever the tokenizer: words stand for texts only where its file proves it."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = [*(t or "" for t in HARD), "Hello world,  hello\n\nworld."]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    encoder = token_ids.text_encoder(path, 2, 2)
    assert isinstance(encoder, token_ids.WordEncoder) == name.startswith("word")
    assert encoder.encode(texts) == [np.array([*e.ids, 2], "<u2").tobytes() for e in want]
    with open(path) as source:
        spec = json.load(source)
    for change in ({"truncation": {"max_length": 5}}, {"normalizer": None}, {"pre_tokenizer": None}, {"post_processor": {"type": "X"}}):
        assert not token_ids.parts_at_white_space({**spec, **change})


def test_other_orders(spark):
    from episodica.llm.shared import fresh_path

    docs = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "c", 2)], "doc_id long, text string, place long")
    path = fresh_path(spark, "ids-order")
    token_ids.write_token_ids(docs, path, token_ids.default_tokenizer(), order="place")
    assert [r.doc_id for r in token_ids.read_token_ids(spark, path).orderBy("start").collect()] == [2, 3, 1]
