"""SimHash near-deduplication with bit-sliced comparison.

Fingerprints: a document's 64 bits are the majority of the bits of its shingles' XXH64. Equal
fingerprints are merged first, so groups of copies of any size cost one fingerprint.

Candidates: 64 bits are cut into ``radius + 2`` blocks; fingerprints within the radius agree in two
blocks at least, so each fingerprint is filed under every pair of blocks. Files of one member are
dropped by a count; files of more than ``TILE`` are cut into chunks, and every pair of chunks is a
tile of its own, so no task holds a hot file.

Comparison: within a tile bit planes are stored vertically, 64 fingerprints to a word. Carry-save
counters add up one plane after another for all pairs at once; words in which every pair is beyond
the radius are dropped on the way. A tile yields a star per linked set, not its pairs.

Null and empty texts have fingerprint zero and link like others; repeated rows are separate
documents with equal fingerprints; component ids ignore null document ids; an empty table gives an
empty result. Every text is used whole; memory is bounded by one batch and one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.components import component_roots
from episodica.llm.shared import in_small_batches, keyed_rows, row_place, rows_at, written, written_small
from episodica.sources.tables import table

#: Fixed values of the contract.
SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
BITS = 64

TILE = 1024
TILE_ROWS = 8192
SMALL_GROUP = 32
QUERY_ROWS = 256
SHINGLE_CHUNK = 1 << 15
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z in lower case."""
    return (text or "").encode().lower().split()  # bytes: ASCII letters and white space only


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles in order, ``SHINGLE_CHUNK`` at a time; fewer words are one shingle."""
    import xxhash

    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if 0 < len(words) < width:
        yield np.array([digest(joined, SEED)], "<u8")
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    for at in range(0, len(words) - width + 1, SHINGLE_CHUNK):
        stop = min(at + SHINGLE_CHUNK, len(words) - width + 1)
        spans = zip(starts[at:stop], starts[at + width : stop + width], strict=True)
        yield np.array([digest(joined[a : b - 1], SEED) for a, b in spans], "<u8")


def majority(chunks: Iterable[np.ndarray]) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in chunks:
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text over its shingles, repeats included."""
    return majority(shingle_hashes(word_bytes(text), width))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row as a signed 64-bit integer."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return in_small_batches(narrow).mapInArrow(_fingerprint_batches, "doc_id bigint, fp bigint")


def block_bounds(radius: int = RADIUS) -> list[tuple[int, int]]:
    """Start and width of the ``radius + 2`` blocks of a fingerprint."""
    n = radius + 2
    cuts = [round(k * BITS / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_keys(fp: Column, radius: int = RADIUS) -> Column:
    """A key for every pair of blocks of a fingerprint, a hash of the pair's number and bits."""
    parts = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in block_bounds(radius)]
    return F.array(*[F.xxhash64(F.lit(k), a, b) for k, (a, b) in enumerate(combinations(parts, 2))])


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row ``b`` has bit ``b`` of all of them, 64 to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Carry-save counters of distances, a word of 64 pairs at a time; they saturate beyond ``radius``."""

    def __init__(self, shape: tuple, radius: int):
        self.radius = radius
        self.levels = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
        self.over = np.zeros(shape, np.uint64)

    def add(self, carry: np.ndarray) -> None:
        """Add one bit to every pair whose bit is set."""
        for k, level in enumerate(self.levels):
            self.levels[k], carry = level ^ carry, level & carry
        self.over |= carry

    def keep(self, chosen: np.ndarray) -> None:
        """Go on with the chosen words only."""
        self.levels, self.over = [x[chosen] for x in self.levels], self.over[chosen]

    def within(self) -> np.ndarray:
        """Words whose set bits are the pairs within the radius."""
        far, equal = self.over.copy(), ~self.over
        for k in reversed(range(len(self.levels))):
            if self.radius >> k & 1:
                equal &= self.levels[k]
            else:
                far |= equal & self.levels[k]
                equal &= ~self.levels[k]
        return ~far


def _hits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bit of every set bit."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def close_in_block(queries: np.ndarray, others: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of a query and another fingerprint within the radius."""
    sliced, rows, cols = planes(others), [], []
    n_words = sliced.shape[1]
    for at in range(0, len(queries), QUERY_ROWS):
        part = queries[at : at + QUERY_ROWS]
        row, word = np.repeat(np.arange(len(part)), n_words), np.tile(np.arange(n_words), len(part))
        counters = Counters(row.shape, radius)
        for b in range(BITS):
            flip = (ALL * (part >> np.uint64(b) & np.uint64(1)))[row]
            counters.add(sliced[b][word] ^ flip)
            if b % 16 == 15 and b < BITS - 1:
                open_words = counters.over != ALL
                if not open_words.all():
                    counters.keep(open_words)
                    row, word = row[open_words], word[open_words]
        k, bit = _hits(counters.within())
        col = word[k] * 64 + bit
        good = col < len(others)
        rows.append(row[k][good] + at)
        cols.append(col[good])
    return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *cols])


def close_in_small_groups(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within the radius inside groups, which lie together and are small.

    Each fingerprint is compared with the one ``d`` places on, for all ``d`` up to the largest group:
    the planes, shifted by ``d`` bits, against themselves.
    """
    sliced, rows, cols = planes(values), [], []
    for d in range(1, int(np.unique(group, return_counts=True)[1].max(initial=1))):
        same = np.zeros(sliced.shape[1] * 64, np.uint8)
        same[: len(group) - d] = group[d:] == group[:-d]
        mask = np.packbits(same, bitorder="little").view(np.uint64)
        shifted = np.pad(sliced, ((0, 0), (0, d // 64 + 2)))[:, d // 64 :]
        right, left = np.uint64(d % 64), np.uint64(64 - d % 64)
        moved = shifted[:, : sliced.shape[1]] >> right
        if d % 64:
            moved |= shifted[:, 1 : sliced.shape[1] + 1] << left
        word = np.nonzero(mask)[0]
        counters = Counters(word.shape, radius)
        for b in range(BITS):
            counters.add(sliced[b][word] ^ moved[b][word])
            if b % 16 == 15 and b < BITS - 1:
                open_words = (counters.over | ~mask[word]) != ALL
                counters.keep(open_words)
                word = word[open_words]
        k, bit = _hits(counters.within() & mask[word])
        rows.append(word[k] * 64 + bit)
        cols.append(rows[-1] + d)
    return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *cols])


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per linked set of ``n`` items with links ``a - b``: items and the first of their set."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    items = np.nonzero(label != np.arange(n))[0]
    return items, label[items]


def _tile_edges(frame: pa.Table, radius: int) -> pa.RecordBatch:
    """Stars of the linked nodes of whole tiles, sorted by tile."""
    key, a, b, chunk, signed = (frame.column(c).to_numpy() for c in ("key", "a", "b", "chunk", "fp"))
    values = signed.view(np.uint64)
    new = np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    tile, first = new.cumsum(), np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(values)))
    links = []
    where = np.flatnonzero(np.repeat(sizes <= SMALL_GROUP, sizes))
    if len(where):
        i, j = close_in_small_groups(values[where], tile[where], radius)
        links.append((where[i], where[j]))
    for start, size in zip(first[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        part, side = values[start : start + size], chunk[start : start + size]
        left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        i, j = close_in_block(part[left], part[right], radius)
        links.append((start + left[i], start + right[j]))
    items, roots = stars(len(values), *(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*links, strict=True)))
    node = frame.column("node").combine_chunks()
    return pa.RecordBatch.from_arrays([node.take(pa.array(items)), node.take(pa.array(roots))], names=["u", "v"])


def _tiles(radius: int):
    """Edges of tiles, which come sorted, at least ``TILE_ROWS`` rows at a time."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < TILE_ROWS:
                continue
            frame = pa.Table.from_batches(held).combine_chunks()
            last = [frame.column(c).to_numpy() for c in ("key", "a", "b")]
            whole = np.flatnonzero((last[0] != last[0][-1]) | (last[1] != last[1][-1]) | (last[2] != last[2][-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0  # the last tile may go on
            if cut:
                yield _tile_edges(frame.slice(0, cut), radius)
            held = frame.slice(cut).combine_chunks().to_batches()
        if held:
            yield _tile_edges(pa.Table.from_batches(held).combine_chunks(), radius)

    return compared


def in_tiles(filed: DataFrame, group: list[str], sizes: DataFrame) -> DataFrame:
    """Rows of ``filed`` dealt out, and sorted, by tile: all pairs of ``chunks`` of every group meet in one.

    ``sizes`` is a plain table of the groups and their number of ``chunks``; groups without are
    dropped. Tiles are named by the group and the columns ``a`` and ``b``; ``chunk`` is a row's own.
    """
    chunks, others = F.col("chunks"), [c for c in filed.columns if c not in group]
    tiles = (
        filed.join(sizes, group)
        .withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(*group, F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", *others)
    )
    return tiles.repartition(*group, "a", "b").sortWithinPartitions(*group, "a", "b", "chunk")


def links(filed: DataFrame, radius: int) -> DataFrame:
    """``u, v``: edges that connect all nodes of a file whose fingerprints are within the radius.

    ``filed`` has ``key, fp, node``. The edges of a tile are stars, fewer than its rows.
    """
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = written_small(sizes.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("chunks")), "file-sizes")
    kind = filed.schema["node"].dataType.simpleString()
    return in_tiles(filed, ["key"], chunks).mapInArrow(_tiles(radius), f"u {kind}, v {kind}")


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: edges that connect all fingerprints within the radius of each other.

    ``prints`` has distinct fingerprints ``fp``, each filed under all pairs of ``radius + 2`` blocks.
    """
    return links(prints.select(F.explode(block_keys(F.col("fp"), radius)).alias("key"), "fp", F.col("fp").alias("node")), radius)


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    by_doc = written(fingerprints(docs, text), "fingerprints")
    distinct = written(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = component_roots(fingerprint_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = written_small(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    components = rooted.join(least, "root").select("fp", "component_id")
    return by_doc.join(components, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for every component, that with the smallest document id; all columns.

    Ids need not be unique: rows are told apart by all their values, and rows without an id come
    after those with one.
    """
    keyed = keyed_rows(docs)
    found = near_duplicates(keyed.select(F.col("__row").alias("doc_id"), F.col("__kept").getField(text).alias("text")), radius=radius)
    of_row = found.select(F.col("doc_id").alias("__of"), "component_id").distinct()
    rows = keyed.select("doc_id", "__row").join(of_row, F.col("__row") == F.col("__of"))
    places = rows.groupBy("component_id").agg(F.min(row_place(F.col("__row"))).alias("place"))
    return rows_at(keyed, places).select("__kept.*")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
