"""Token ids in fixed-width bit-packed shards with random access.

A shard holds the ids of consecutive documents, each id in the fewest bits that hold the largest
vocabulary id, in blocks of ``BLOCK_IDS`` ids:

    magic, u32 bits, u32 ids per block            header, 16 bytes
    blocks, each of BLOCK_IDS * bits / 8 bytes    the last one is filled up with zeros
    i64 doc_id, i64 n_ids, u8 id-is-null per document, then u64 offset per block
    u64 number of ids, of documents, of blocks, offset of the index, magic

Ids are packed from the least significant bit up, so numpy unpacks a block without a loop, and the
block offsets lead to any id. Documents are range-partitioned by id, so shards in partition order
are the whole corpus in order; the manifest adds the number of ids before each shard.

Null texts are empty (one end id), null ids come first, repeated rows are separate documents, an
empty table gives no rows. Memory is bounded by one Arrow batch, a block and the shard's index.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import files
from episodica.llm.shared import fresh_path, in_small_batches
from episodica.sources.tables import table

MAGIC = b"EPTOKID1"
BLOCK_IDS = 8192
READ_IDS = 1 << 19
END_ID = 2

#: Documents encoded at once; words learnt at once, of a generation of the memo, and the longest that it keeps.
ENCODE_DOCS, LEARN_WORDS, MEMO_WORDS, MEMO_BYTES = 250, 256, 500_000, 48

#: Marks that a word may end in.
CLOSING = b".,!?;:%$*#&|"

#: Fixed value: a splitter into letters, digits and other marks that drops white space.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def id_bits(vocabulary: int) -> int:
    """Fewest bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def vocabulary_size(tokenizer: str) -> int:
    """One more than the largest id of a tokenizer's file; the driver does not load the tokenizer."""
    with open(tokenizer, encoding="utf-8") as source:
        spec = json.load(source)
    vocabulary = spec["model"]["vocab"]
    known = vocabulary.values() if isinstance(vocabulary, dict) else range(len(vocabulary))
    return 1 + max([*known, *(t["id"] for t in spec.get("added_tokens", ()))])


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (a multiple of 8 of them) in ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(lanes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    """Inverse of ``pack``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}").astype("<u4")
    lanes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").reshape(-1, bits)
    return lanes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def ends_in_letter(text: str) -> bool:
    """Is the last character a letter, also once it is normalised and in lower case?"""
    return unicodedata.normalize("NFC", text[-1])[-1].lower().isalpha()


def parts_at_white_space(spec: dict) -> bool:
    """Does a tokenizer's file prove that the ids of a text are those of its words in turn?

    The normaliser may only compose characters, lower-case them (it must) and turn white space into
    spaces; the splitter must drop white space and split letters from other marks; nothing may be
    added, cut or padded; added tokens hold no white space and take none beside them.
    """
    flat = lambda node, key: [x for part in node[key] for x in flat(part, key)] if node and key in node else [node]
    normal = flat(spec.get("normalizer"), "normalizers")
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    split = {"type": "Split", "pattern": {"Regex": WORD_PIECES}, "behavior": "Removed", "invert": True}
    pre = flat(spec.get("pre_tokenizer"), "pretokenizers")
    return (
        all(n in ({"type": "NFC"}, {"type": "Lowercase"}, spaces) for n in normal)
        and {"type": "Lowercase"} in normal
        and bool(pre)
        and pre[0] == split
        and all(p == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False} for p in pre[1:])
        and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", ()))
    )


class TextEncoder:
    """Little-endian ids of whole texts, each with the end id, by the library's ``encode_batch``."""

    def __init__(self, path: str, width: int, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.code = Tokenizer.from_file(path), {2: "H", 4: "I"}[width]
        self.end = array(self.code, [end_id]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text."""
        found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() + self.end for e in found]


class WordEncoder(TextEncoder):
    """The same ids for tokenizers that ``parts_at_white_space``: every word is encoded once and kept.

    White space is the ASCII one. Words are looked up in ASCII lower case, unless the text might hold
    an added token, which is told apart by case. Words that are new to a batch of texts are encoded
    together, as one text. Punctuation behind a letter starts a new piece, so a word and its closing
    marks are learnt apart. Words asked for again are kept through the next generation of
    ``MEMO_WORDS`` words, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str, width: int, end_id: int):
        super().__init__(path, width, end_id)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def words(self, text: str | None) -> list[bytes]:
        """Words of a text as they are looked up."""
        data = (text or "").encode()
        lower = data.lower()  # bytes: ASCII letters only
        return (data if any(a in lower for a in self.added) else lower).split()

    def encode_apart(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of every word, of ``LEARN_WORDS`` at a time as one text."""
        for at in range(0, len(words), LEARN_WORDS):
            part = [w.decode() for w in words[at : at + LEARN_WORDS]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, begins = array(self.code, found.ids), [o[0] for o in found.offsets]
            cuts = [bisect_left(begins, start) for start in accumulate((len(w) + 1 for w in part), initial=0)]
            yield from (ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not in the memo."""
        known, whole, split = {}, set(), []
        for word in words:
            if (ids := self.older.get(word)) is not None:
                known[word] = ids
                continue
            core = word.rstrip(CLOSING)
            if core and len(core) < len(word) and (97 <= core[-1] <= 122 or ends_in_letter(core.decode())):
                split.append((word, core, word[len(core) :]))
                whole.update(split[-1][1:])
            else:
                whole.add(word)
        fresh = []
        for word in whole:
            ids = self.memo.get(word) or self.older.get(word)
            if ids is None:
                fresh.append(word)
            else:
                known[word] = ids
        known.update(zip(fresh, self.encode_apart(fresh), strict=True))
        known.update((word, known[core] + known[marks]) for word, core, marks in split)
        return known

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, word by word."""
        memo, split = self.memo, [self.words(t) for t in texts]
        new = {w for words in split for w in words if w not in memo}
        memo.update(self.learn(new))
        out = [b"".join(map(memo.__getitem__, words)) + self.end for words in split]
        for word in [w for w in new if len(w) > MEMO_BYTES]:
            del memo[word]
        if len(memo) > MEMO_WORDS:
            self.memo, self.older = {}, memo
        return out


def text_encoder(path: str, width: int, end_id: int) -> TextEncoder:
    """The encoder for a tokenizer's file: by words where the file proves that they stand for the text."""
    with open(path, encoding="utf-8") as source:
        by_words = parts_at_white_space(json.load(source))
    return (WordEncoder if by_words else TextEncoder)(path, width, end_id)


@cache
def worker_encoder(path: str, width: int, end_id: int) -> TextEncoder:
    """The encoder that all tasks of a Python worker share."""
    return text_encoder(path, width, end_id)


def in_order(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``doc_id, text`` in ascending order of a column over the partitions; equal ones by id and a hash of the text."""
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col(f"`{order}`").alias("__order"), F.xxhash64("text").alias("__tie"))
    by = ["__order", "doc_id", "__tie"]
    return ordered.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")


class ShardWriter:
    """Encodes ``doc_id, text`` and packs the ids; one Python worker does both."""

    def __init__(self, path: str, bits: int, tokenizer: str, end_id: int):
        self.path, self.bits, self.tokenizer, self.end_id = path, bits, tokenizer, end_id

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([self.write(batches)])

    def write(self, batches: Iterator[pa.RecordBatch]) -> dict:
        """Write a partition as a shard under a name of this attempt."""
        partition = TaskContext.get().partitionId()
        size = 2 if self.bits <= 16 else 4
        width, encoder = f"<u{size}", worker_encoder(self.tokenizer, size, self.end_id)
        store, path = files.open_store(self.path)
        store.create_dir(path, recursive=True)
        name, docs, counts, nulls, offsets, at, total = files.attempt_name(partition, ".ids"), [], [], [], [], 16, 0
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(MAGIC + struct.pack("<II", self.bits, BLOCK_IDS))
            rest = np.empty(0, width)

            def blocks(ids: np.ndarray) -> None:
                nonlocal at
                data = pack(ids, self.bits)
                step = BLOCK_IDS * self.bits // 8
                offsets.extend(range(at, at + len(data), step))
                at += len(data)
                out.write(data)

            for batch in (b.slice(at, ENCODE_DOCS) for b in batches for at in range(0, len(b), ENCODE_DOCS)):
                # Copies: a view of a column would keep the whole batch with its texts.
                docs.append(np.array(batch.column(0).fill_null(0)))
                nulls.append(np.array(batch.column(0).is_null(), np.uint8))
                parts = [np.frombuffer(x, width) for x in encoder.encode(batch.column(1).to_pylist())]
                counts.append(np.array([len(p) for p in parts], "<i8"))
                ids = np.concatenate([rest, *parts])
                total += len(ids) - len(rest)
                full = len(ids) // BLOCK_IDS * BLOCK_IDS
                if full:
                    blocks(ids[:full])
                rest = ids[full:].copy()
            if len(rest):
                blocks(np.pad(rest, (0, BLOCK_IDS - len(rest))))
            n_docs = sum(map(len, docs))
            for parts, kind in ((docs, "<i8"), (counts, "<i8"), (nulls, "u1"), ([np.array(offsets)], "<u8")):
                out.write(np.concatenate([np.empty(0, kind), *parts]).astype(kind).tobytes())
            out.write(struct.pack("<QQQQ", total, n_docs, len(offsets), at) + MAGIC)
        return {"partition": partition, "name": name, "n_ids": total, "n_docs": n_docs}


class Shard:
    """Random access to one shard."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        assert tail[32:] == MAGIC, f"{path} is no shard of token ids"
        self.n_ids, self.n_docs, n_blocks, index = struct.unpack("<QQQQ", tail[:32])
        self.bits, self.block_ids = struct.unpack("<II", self.file.read_at(16, 0)[8:])
        data = self.file.read_at(size - 40 - index, index)
        n = self.n_docs
        self.doc_ids, self.counts = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n)
        self.nulls = np.frombuffer(data, "u1", n, 16 * n)
        self.offsets = np.append(np.frombuffer(data, "<u8", n_blocks, 17 * n), index).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.counts))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` of the shard, reading their blocks only."""
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        at = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - at, at)
        return unpack(data, self.bits)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """The ids of the ``k``-th document of the shard."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def read_shard(store, folder: str, entry: dict) -> Iterator[pa.RecordBatch]:
    """The documents of a shard of the manifest, about ``READ_IDS`` ids at a time."""
    shard, first = Shard(store, f"{folder}/{entry['name']}"), 0
    while first < shard.n_docs:
        stop = max(first + 1, int(np.searchsorted(shard.starts, shard.starts[first] + READ_IDS, "right")) - 1)
        ids = shard.ids(int(shard.starts[first]), int(shard.starts[stop])).astype("<u4")
        cuts = shard.starts[first : stop + 1] - shard.starts[first]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shard.doc_ids[first:stop], pa.int64(), mask=shard.nulls[first:stop].astype(bool)),
                pa.array(entry["start"] + shard.starts[first:stop]),
                pa.array(shard.counts[first:stop]),
                pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            ],
            names=["doc_id", "start", "n_tokens", "ids"],
        )
        first = stop


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, order: str = "doc_id") -> None:
    """Encode whole texts and write them as shards under ``path`` in ascending order of a column.

    ``order`` may name another column than the id, such as the place of a mix.
    """
    bits = id_bits(vocabulary_size(tokenizer))
    written = in_small_batches(in_order(docs, order)).mapInArrow(
        ShardWriter(path, bits, tokenizer, end_id), "partition bigint, name string, n_ids bigint, n_docs bigint"
    )
    entries, before = [], 0
    for shard in sorted(written.collect()):  # one row per shard, of the attempts that succeeded
        entries.append({"name": shard.name, "start": before, "n_docs": shard.n_docs})
        before += shard.n_ids
    files.write_manifest(path, {"bits": bits, "shards": entries})


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a folder of shards, a task per shard.

    ``ids`` are little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = files.open_store(path)
        shards = files.read_manifest(path)["shards"]
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from read_shard(store, folder, shards[k])

    n = len(files.read_manifest(path)["shards"])
    numbers = spark.range(0, n, 1, max(1, n))
    return numbers.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def default_tokenizer() -> str:
    """The word-level BPE of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as token ids, read the files back, and give each document's place and checksum."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write_token_ids(docs, path, tokenizer or default_tokenizer())
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token-id files."""
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
