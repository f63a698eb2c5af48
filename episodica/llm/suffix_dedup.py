"""Removal of byte strings that repeat, by a sample of positions that equal strings share.

Every byte that is covered by a ``LENGTH``-byte string which also starts earlier is removed. Only the
first ``LENGTH`` bytes of a suffix count, and equal strings only have to meet, so this is no suffix
array: a difference cover by residues would sort two positions in three of the corpus, and again at
every level of names, which is many times the input (see the README). Instead:

* Sample. Three words of 8 bytes are a triple, and a mixed number its name. A string's sample is the
  position in it whose triple has the least name: one position in 39, at the same offset in equal
  strings. A name that occurs once has no repeat, and its strings, most of the corpus, are left out.
* Names. The name of 72 bytes is mixed from three names of triples, that of a string from the 72-byte
  name, the next triple's and its last word.
* Meet. Strings that share a sample are brought together with the bytes around it and ordered by
  their names; each is compared byte by byte with the first of its name, and all but the first of
  equal bytes are marked. Names only bring strings together; bytes alone decide.

Texts that an earlier document has whole are settled by a hash and take no further part. A name with
more than ``HOT`` samples is dealt out by a salt; strings that are first within their
salt meet again with their bytes. So no task holds a hot group, and nothing is collected.

Null texts are empty. Rows that repeat a document id and its text are one document; rows that
repeat an id with other texts are documents ordered by a hash of the text; null ids come first; an
empty table gives an empty result. Texts are used whole, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import in_small_batches, written
from episodica.sources.tables import table

#: Fixed value of the contract.
LENGTH = 100

WORD, TRIPLE = 8, 24
HOT = 4_000
PIECE = 1 << 16
MERGE_BYTES = 2 << 20
LOW = np.uint64((1 << 18) - 1)
#: Names of samples have 48 bits: of the 3e12 samples of 100 TB, one in a hundred meets its name by chance.
NAME_SHIFT = np.uint64(16)
NO_ID = -(1 << 63)
OUT_ROWS = 100_000

#: Odd multipliers of the mixed names, from the fractional parts of square roots.
MIX = [np.uint64(int((p**0.5 % 1) * 2**52) << 11 | 1) for p in (2, 3, 5, 7, 11, 13, 17)]


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8-byte word at every byte position."""
    return np.ndarray((len(data) - WORD + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x *= factor
    x ^= x >> np.uint64(29)
    return x


def triple_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed words, and names of the triples, at every byte position that has one."""
    word = _mixed(words_at(data), MIX[0])
    n = len(data) - TRIPLE + 1
    name = word[:n] * MIX[1]
    name += word[WORD : WORD + n] * MIX[2]
    name += word[2 * WORD : 2 * WORD + n] * MIX[3]
    name ^= name >> np.uint64(31)
    return word, _mixed(name, MIX[4])


def string_names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the ``LENGTH``-byte strings that start at ``at``: triples of names, and what is left."""
    word, triple = triple_names(data)
    name = triple[at] * MIX[1]
    name += triple[at + TRIPLE] * MIX[2]
    name += triple[at + 2 * TRIPLE] * MIX[3]
    name ^= name >> np.uint64(31)
    name *= MIX[4]
    name += triple[at + 3 * TRIPLE] * MIX[5]
    name += word[at + LENGTH - WORD] * MIX[6]
    name ^= name >> np.uint64(31)
    return _mixed(name, MIX[2])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def samples(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with the same sample in a buffer of pieces.

    ``first`` and ``count`` give each piece's first string and number of strings. Returns per run
    its piece, its first string, its length, the sample's offset and the sample's 48-bit name.
    """
    _, name = triple_names(data)
    order = (name & ~LOW) | np.arange(len(name), dtype=np.uint64)
    at = (sliding_least(order, LENGTH - TRIPLE + 1) & LOW).astype(np.int64)
    changed = np.zeros(len(at) + 1, bool)
    changed[1:-1] = at[1:] != at[:-1]
    changed[first] = True
    valid = np.zeros(len(at) + 1, np.int8)
    valid[first] += 1
    np.subtract.at(valid, first + count, 1)
    start = np.flatnonzero(changed & (valid.cumsum() > 0))
    piece = np.searchsorted(first, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(at)), (first + count)[piece])
    sample = at[start]
    return piece, start, stop - start, sample - start, ((name[sample] * MIX[5]) >> NAME_SHIFT).view(np.int64)


def _text_bytes(value: pa.Scalar) -> memoryview:
    buffer = value.as_buffer()
    return memoryview(b"" if buffer is None else buffer)


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key columns and text in; ``name, place`` and key columns out."""
    for batch in batches:
        keys = batch.columns[:-1]
        names = ["name", "place", *batch.schema.names[:-1]]
        pieces: list[tuple[int, int, memoryview]] = []
        size = 0
        for row, value in enumerate(batch.column(batch.num_columns - 1)):
            data = _text_bytes(value)
            for start in range(0, len(data) - LENGTH + 1, PIECE):
                piece = data[start : start + PIECE + LENGTH - 1]
                if size + len(piece) > 2 * PIECE:
                    yield from _sampled(pieces, keys, names)
                    pieces, size = [], 0
                pieces.append((row, start, piece))
                size += len(piece)
        yield from _sampled(pieces, keys, names)


def _sampled(pieces: list[tuple[int, int, memoryview]], keys: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    if not pieces:
        return
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    lengths = np.array([len(p) for _, _, p in pieces])
    first = np.append(0, lengths.cumsum()[:-1])
    piece, start, n, offset, name = samples(data, first, lengths - LENGTH + 1)
    rows = pa.array(np.array([r for r, _, _ in pieces])[piece])
    begin = np.array([s for _, s, _ in pieces])[piece] + start - first[piece]
    place = begin << 16 | n << 8 | offset
    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(place), *[k.take(rows) for k in keys]], names=names)


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key columns, text and ``runs`` in; key columns, ``start, offset, salts, context`` out."""
    for batch in batches:
        keys, names = batch.columns[:-2], [*batch.schema.names[:-2], "start", "offset", "salts", "context"]
        rows, starts, offsets, salts, contexts = [], [], [], [], []

        def out(rows=rows, starts=starts, offsets=offsets, salts=salts, contexts=contexts, keys=keys, names=names):
            taken = pa.array(rows, pa.int64())
            made = [pa.array(starts, pa.int64()), pa.array(offsets, pa.int32()), pa.array(salts, pa.int32()), pa.array(contexts, pa.binary())]
            for values in (rows, starts, offsets, salts, contexts):
                values.clear()
            return pa.RecordBatch.from_arrays([*[k.take(taken) for k in keys], *made], names=names)

        for row, (text, runs) in enumerate(zip(batch.column(len(keys)), batch.column(len(keys) + 1), strict=True)):
            data = bytes(_text_bytes(text))
            values = runs.values
            place, salt = (np.asarray(values.field(k)) for k in (0, 1))
            start, n, offset = place >> 16, place >> 8 & 255, place & 255
            rows += [row] * len(place)
            starts += start.tolist()
            offsets += offset.tolist()
            salts += salt.tolist()
            contexts += [data[a:b] for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)]
            if len(rows) >= OUT_ROWS:
                yield out()
        if rows:
            yield out()


def mark_repeats(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which strings of contexts repeat an earlier one of the same group.

    Contexts lie one after another in ``data`` at ``offsets``, in the order that decides what is
    earlier. Returns per string its context, its start in ``data``, its name, and whether it repeats.
    """
    counts = np.diff(offsets) - LENGTH + 1
    context = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(context)) - np.repeat(counts.cumsum() - counts, counts) + offsets[:-1][context]
    name = string_names(data, at)
    placed = name + group[context] * MIX[0]
    order = np.argsort(placed)
    ranked = placed[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    first = np.minimum.reduceat(order, begin)
    repeats = np.ones(len(at), bool)
    repeats[first] = False
    first_of = np.empty(len(at), np.int64)
    first_of[order] = np.repeat(first, np.diff(np.append(begin, len(order))))
    marked = np.flatnonzero(repeats)
    word = np.ndarray((len(data) - WORD + 1,), "<u8", data, strides=(1,))
    differ = np.zeros(len(marked), bool)
    for k in [*range(0, LENGTH - WORD, WORD), LENGTH - WORD]:
        differ |= word[at[marked] + k] != word[at[first_of[marked]] + k]
    if differ.any():  # two strings of one name: those of such names are told apart by their bytes
        some = np.flatnonzero(np.isin(placed, np.unique(placed[marked[differ]])))
        strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at[some]]
        owner = np.unique(group[context[some]], return_inverse=True)[1].astype("<i8")
        whole = np.ascontiguousarray(np.hstack([strings, owner[:, None].view(np.uint8)])).view(f"V{LENGTH + 8}").ravel()
        _, first_at, same = np.unique(whole, return_index=True, return_inverse=True)
        repeats[some] = first_at[same] != np.arange(len(some))
    return context, at, name, repeats


def _merge(table_: pa.Table, keys: list[str]) -> pa.RecordBatch:
    """Marked spans of whole groups, and the strings of salted groups that are first in theirs."""
    columns = {k: table_.column(k).to_numpy() for k in (*keys, "start", "salts", "group")}
    order = np.lexsort([columns["start"], *[columns[k] for k in reversed(keys)]])
    contexts = table_.column("context").combine_chunks().take(pa.array(order))
    contexts = contexts.combine_chunks() if isinstance(contexts, pa.ChunkedArray) else contexts
    columns = {k: v[order] for k, v in columns.items()}
    _, off, buf = contexts.buffers()
    offsets = np.frombuffer(off, np.int32, len(contexts) + 1, contexts.offset * 4).astype(np.int64)
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    context, at, name, repeats = mark_repeats(np.ascontiguousarray(data), offsets, columns["group"].view(np.uint64))
    begin = np.flatnonzero(repeats & ~(np.append(False, repeats[:-1]) & np.append(False, context[1:] == context[:-1])))
    end = np.flatnonzero(repeats & ~(np.append(repeats[1:], False) & np.append(context[1:] == context[:-1], False)))
    open_ = np.flatnonzero(~repeats & (columns["salts"] > 1)[context])
    row = np.concatenate([context[begin], context[open_]])
    string = np.concatenate([begin, open_])
    start = columns["start"][row] + at[string] - offsets[:-1][row]
    stop = np.concatenate([start[: len(begin)] + at[end] - at[begin], start[len(begin) :]]) + LENGTH
    spans = np.arange(len(string)) < len(begin)
    open_name = pa.array(name[string].view(np.int64), mask=spans)
    flat = np.ascontiguousarray(data)
    open_bytes = pa.array([None] * len(begin) + [flat[k : k + LENGTH].tobytes() for k in at[open_].tolist()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [*[pa.array(columns[k][row]) for k in keys], pa.array(start), pa.array(stop), open_name, open_bytes],
        names=[*keys, "start", "stop", "open_name", "open_bytes"],
    )


def _merge_batches(keys: list[str]):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                part = batch.slice(at, 20_000)
                held.append(part)
                size += part.column("context").nbytes
                if size < MERGE_BYTES:
                    continue
                whole = pa.Table.from_batches(held)
                group = whole.column("group").to_numpy()
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield _merge(whole.slice(0, cut), keys)
                    held = whole.slice(cut).combine_chunks().to_batches()
                    size = sum(b.column("context").nbytes for b in held)
        if held:
            yield _merge(pa.Table.from_batches(held), keys)

    return merged


def _settle_batches(keys: list[str]):
    """Spans pass; of open strings, sorted by name, bytes and order, those after the first of equal bytes do."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            strings = batch.column("open_bytes")
            after = []
            for value in strings.to_pylist() if strings.null_count < len(batch) else [None] * len(batch):
                after.append(value is None or value == last)
                last = value
            yield batch.filter(pa.array(after, pa.bool_())).select([*keys, "start", "stop"])

    return settled


def repeated_spans(docs: DataFrame, keys: list[str], settled: DataFrame) -> DataFrame:
    """Spans of bytes that repeat earlier ones: key columns, ``start, stop``; they may overlap.

    ``docs`` has the key columns, bigints that are unique and in order of what is earlier, and
    ``text``. Documents whose keys are in ``settled`` are left out.
    """
    key_schema = ", ".join(f"{k} bigint" for k in keys)
    sampled = docs.join(settled, keys, "left_anti").select(*keys, "text").mapInArrow(_sample_batches, f"name bigint, place bigint, {key_schema}")
    # Written, so that the join reads a plain table and Spark can split its hot names.
    often = written(sampled.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "names")
    salts = F.ceil(F.col("n") / HOT).cast("int")
    runs = (
        sampled.join(often, "name")
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("place", salts.alias("salts"))).alias("runs"))
    )
    contexts = (
        docs.join(runs, keys)
        .select(*keys, "text", "runs")
        .mapInArrow(_context_batches, f"{key_schema}, start bigint, offset int, salts int, context binary")
    )
    triple = F.substring("context", F.col("offset") + 1, F.lit(TRIPLE))
    salt = F.pmod(F.xxhash64(*keys, "start"), F.col("salts"))
    grouped = contexts.select(*keys, "start", "salts", "context", F.xxhash64(triple, salt).alias("group"))
    marked = (
        grouped.repartition("group").sortWithinPartitions("group").mapInArrow(_merge_batches(keys), f"{key_schema}, start bigint, stop bigint, open_name bigint, open_bytes binary")
    )
    met = marked.repartition(F.coalesce("open_name", F.xxhash64(*keys, "start"))).sortWithinPartitions("open_name", "open_bytes", *keys, "start")
    return met.mapInArrow(_settle_batches(keys), f"{key_schema}, start bigint, stop bigint")


def maximal_runs(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(new[1:], True)]


def _removal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text, spans`` in; the digest of what is left out."""
    for batch in batches:
        found = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = _text_bytes(text)
            digest, at, removed, n_spans = hashlib.sha256(), 0, 0, 0
            if spans.is_valid and len(spans):
                begin, end = maximal_runs(*(np.asarray(spans.values.field(k)) for k in (0, 1)))
                removed, n_spans = int((end - begin).sum()), len(begin)
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    digest.update(data[at:a])
                    at = b
            digest.update(data[at:])
            found.append((len(data), removed, n_spans, digest.hexdigest()))
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def copies(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns, ``start, stop``: whole texts that an earlier document has as well.

    Every byte of such a text is covered by an earlier string, and any string in it starts earlier
    still in the first copy. Hashes that occur twice are aggregated map-side and written, so that
    Spark can split hot ones in the join.
    """
    hashed = docs.select(F.struct(*keys).alias("key"), F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("stop"))
    first = hashed.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = hashed.where(F.col("stop") >= LENGTH).join(written(first.select("sha", "first"), "first"), "sha").where("key > first")
    return later.select("key.*", F.lit(0).cast("long").alias("start"), "stop")


def _keyed(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with key columns, unique but for repeated rows, and whole texts in ``text``."""
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text": F.coalesce(F.col(text), F.lit(""))})
    if keyed.groupBy("__id").count().where("count > 1").isEmpty():
        return keyed, ["__id"]
    return keyed.withColumn("__hash", F.xxhash64("text")), ["__id", "__hash"]


def _spans_by_key(narrow: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns and ``spans`` for texts ``(keys, text)`` with spans that repeat earlier text."""
    unique = narrow if len(keys) == 1 else narrow.dropDuplicates(keys)
    whole = written(copies(unique, keys), "copies")
    spans = repeated_spans(unique, keys, whole.select(*keys)).unionByName(whole)
    return spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``, an array of ``(start, stop)`` byte spans that repeat earlier text, or null.

    A column of that name is replaced; all others stay as they are.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"]).alias("__kept")
    keyed, keys = _keyed(docs.select("doc_id", F.col(f"`{text}`").alias("text"), kept), "text")
    return keyed.join(_spans_by_key(keyed.select(*keys, "text"), keys), keys, "left").select("__kept.*", "spans")


def removal_digests(docs: DataFrame) -> DataFrame:
    """Per row: bytes, removed bytes, maximal removed runs, and the SHA-256 of what is left.

    Cutting out contexts and removing spans read one exchange of the texts by key.
    """
    keyed, keys = _keyed(docs.select("doc_id", "text"), "text")
    narrow = in_small_batches(keyed.select(*keys, "text"))
    found = narrow.join(_spans_by_key(narrow, keys), keys, "left").select(
        F.when(F.col("__id") != NO_ID, F.col("__id")).alias("doc_id"), "text", "spans"
    )
    return found.mapInArrow(_removal_batches, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once strings of 100 bytes that also start earlier are removed."""
    return removal_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
