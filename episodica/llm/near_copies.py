"""Near copies of whole texts: SimHash near-deduplication over five-word shingles, verified exactly.

Two texts are near copies if the sets of their shingles of ``SHINGLE_WORDS`` words have a Jaccard
similarity of ``THRESHOLD`` or more; a text of fewer words is one shingle. Texts of equal words, A-Z
in lower case, have one name, so copies in any number cost one text.

* Files. At that similarity 64-bit fingerprints differ in 10 bits, give or take 3, beyond what blocks
  of a fingerprint can select by. A text is therefore filed under ``BANDS`` keys, each a hash of the
  least of its shingles under ``ROWS`` permutations; two texts of similarity 0.8 share a key with a
  probability of 0.997, more similar ones more surely.
* Comparison. Inside files, fingerprints are compared by the bit-sliced tiles of ``simhash`` at a
  radius of ``RADIUS`` bits, beyond the spread. Linked sets are stars, not pairs.
* Verification. Texts of a candidate component meet in tiles of bounded size, where their sets are
  compared exactly. Pairs that are already connected are left out, so a group of copies of any size
  needs about one comparison a text, and no link between components is lost.

Null and empty texts are one text; rows are told apart by all their values and rows without an id
come after those with one; repeated rows count once; an empty table gives an empty result. A text
is held whole, a tile holds ``TILE`` texts or ``TILE_SHINGLES`` shingles of each side, and one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.components import component_roots
from episodica.llm.shared import ROW_NAME, in_small_batches, keyed_rows, row_name, row_place, rows_at, written, written_small
from episodica.llm.simhash import close_in_block, in_tiles, links, majority, shingle_hashes, word_bytes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RADIUS = 20
BANDS, ROWS = 8, 3

TILE, TILE_SHINGLES = 512, 1 << 20
SLICE = 1 << 12

#: Permutations of 64-bit numbers: added, then multiplied by an odd number, of a fixed generator.
_ADDED, _FACTORS = np.random.default_rng(1).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(words, SHINGLE_WORDS)]))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key per band from the least shingles under its permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), SLICE):
        np.minimum(least, ((shingles[at : at + SLICE, None] + _ADDED) * _FACTORS).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * _FACTORS[0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row columns and text in; row columns, ``node, fp, n, keys`` out."""
    for batch in batches:
        names, prints, sizes, keys = [], [], [], []
        for text in batch.column(batch.num_columns - 1):
            words = word_bytes(text.as_py())
            shingles = shingle_set(words)
            names.append(md5(b" ".join(words)).digest())
            prints.append(majority([shingles]))
            sizes.append(len(shingles))
            keys.append(band_keys(shingles) if len(shingles) else np.empty(0, np.int64))
        offsets = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
        filed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
        made = [pa.array(names, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), filed]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "node", "fp", "n", "keys"])


def connected(left: list[int], right: list[int], sets: list[np.ndarray], near: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs that connect all texts which similar pairs connect.

    ``near[i, j]`` says which of the pairs ``left[i], right[j]`` may be similar.
    """
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    found, columns = [], np.array(right)
    for i, row in zip(left, near, strict=True):
        open_, step = columns[row & (columns != i)], 1
        a, b = np.minimum(sizes[i], sizes[open_]), np.maximum(sizes[i], sizes[open_])
        open_ = open_[a >= THRESHOLD * b - 1e-9]
        while len(open_ := open_[label[open_] != label[i]]):
            for j in open_[:step].tolist():
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if label[i] != label[j] and shared >= THRESHOLD * (sizes[i] + sizes[j] - shared) - 1e-9:
                    found.append((i, j))
                    label[label == label[j]] = label[i]
            open_, step = open_[step:], 4 * step
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of ``root, a, b, chunk, node, fp, text`` in; edges between similar texts out."""

    def edges(rows: list[dict]) -> list[tuple[bytes, bytes]]:
        sides = [r["chunk"] for r in rows]
        left = [k for k, c in enumerate(sides) if c == sides[0]]
        right = [k for k, c in enumerate(sides) if c == sides[-1]]
        prints = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
        near = np.zeros((len(left), len(right)), bool)
        near[close_in_block(prints[left], prints[right], RADIUS)] = True
        pairs = connected(left, right, [r["set"] for r in rows], near)
        return [(rows[i]["node"], rows[j]["node"]) for i, j in pairs]

    def out(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

    rows: list[dict] = []
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if rows and any(row[c] != rows[0][c] for c in ("root", "a", "b")):
                found += edges(rows)
                rows = []
            rows.append({**row, "set": shingle_set(word_bytes(row.pop("text")))})
        yield out(found)
    if rows:
        yield out(edges(rows))


def similar_links(keyed: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``u, v``: edges that connect the names of similar texts.

    ``keyed`` has the rows as ``keyed_rows``; ``texts`` a row per name: ``node, place, fp, n, keys``.
    """
    filed = texts.select("node", "fp", F.explode("keys").alias("key"))
    roots = written(component_roots(links(filed, RADIUS)), "candidates")
    rooted = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    members = written(texts.join(rooted, F.col("node") == F.col("u")).select("root", "node", "fp", "n", "place"), "members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("chunks"))
    named = row_name(F.col("place.no_id"), F.col("place.id"), F.col("place.row"))
    wanted = members.withColumns(named).drop("place", "n")
    rows = keyed.select("doc_id", "__row", F.col("__kept").getField(text).alias("text")).withColumns(row_name(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row")))
    texts_of = rows.join(wanted, [*ROW_NAME]).dropDuplicates([*ROW_NAME]).select("root", "node", "fp", "text")
    tiles = in_tiles(texts_of, ["root"], written_small(sizes, "component-sizes"))
    return in_small_batches(tiles).mapInArrow(_verified, "u binary, v binary")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of ``docs`` for every component of near copies, that with the smallest id; all columns."""
    keyed = keyed_rows(docs)
    narrow = keyed.select("doc_id", "__row", F.col("__kept").getField(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = in_small_batches(narrow).mapInArrow(_signatures, f"doc_id {kind}, __row bigint, node binary, fp bigint, n bigint, keys array<bigint>")
    least = F.min(F.struct(row_place(F.col("__row")).alias("place"), "fp", "n", "keys")).alias("x")
    texts = written(signed.groupBy("node").agg(least).select("node", "x.*"), "texts")
    roots = component_roots(similar_links(keyed, texts, text))
    rooted = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    placed = written(texts.select("node", "place").join(rooted, F.col("node") == F.col("u")).select("node", "place", "root"), "placed")
    best = written_small(placed.groupBy("root").agg(F.min("place").alias("least")), "best")
    lost = placed.join(best, "root").where("place > least").select("node")
    return rows_at(keyed, texts.join(lost, "node", "left_anti").select("place")).select("__kept.*")
