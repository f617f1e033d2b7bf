"""Near dedup of the pipeline: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from eight independent Golay fingerprints.  Each is a min-wise hash of the shingles together with one bit of
each of 23 others, read as a word of the (23, 12) Golay code.  At similarity s the value agrees with probability s and a bit
differs with probability (1 - s) / 2; the keys are the value with the codeword of the word itself and of all words one bit
away, about 42 a document, so that words up to two bits apart share one.  Among the documents of a key those are linked
that differ in at most 16 of 64 of the bits.

Candidates only say what is compared: the documents that links connect form a block, and within it every pair is held
against the similarity by whole shingle sets.  A large block is cut into parts, and each pair of parts is a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep_first, staged, text_key
from .simhash import SEED, golay_index, golay_tables

SHINGLE_WORDS = 5
#: Least similarity of near duplicates, as a fraction.
SIMILAR = (4, 5)
FINGERPRINTS = 8
WORD_BITS = 23
#: Differing bits, of 64, up to which documents of one key are linked: four deviations above what 0.8 gives.
LINK_BITS = 16
#: Documents of one key that a task compares; of a key with more, all are linked.
BLOCK = 1 << 15
#: Shingles of a part of a block.
PART = 1 << 20

_ROWS = 1024
_EACH = WORD_BITS + 1
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) | 1 for i in range(FINGERPRINTS * _EACH)], np.uint64)


# ---------------------------------------------------------------- sketches
def shingles(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted different hashes of the shingles of a UTF-8 text; a text shorter than a shingle is one shingle."""
    tokens = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII white space characters only
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in spans), np.uint64, n))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """For each fingerprint the min-wise value (41 bits) and the 23-bit word below it, and 64 of the words' bits."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _ROWS):
        low = np.minimum(low, (hashes[at:at + _ROWS, None] * _FACTORS).min(axis=0))
    low = (low >> np.uint64(8)).reshape(FINGERPRINTS, _EACH)
    words = ((low[:, 1:] & np.uint64(1)) << np.arange(WORD_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    bits = ((words & np.uint64(255)) << (np.arange(FINGERPRINTS, dtype=np.uint64) * np.uint64(8))).sum(dtype=np.uint64)
    return low[:, 0] << np.uint64(WORD_BITS) | words, int(bits.view(np.int64))


def sketch_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, row_text, fp (hash of the shingle set), size of the set, prints and bits of every row, written once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            fps = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            found = [sketch(s) for s in sets]
            prints = pa.array([p.view(np.int64) for p, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), prints, pa.array([b for _, b in found], pa.int64())],
                                             ["row_id", "row_text", "fp", "size", "prints", "bits"])

    source = docs.select(F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["row_id"].dataType.simpleString()
    return staged(source.mapInArrow(each, f"row_id {kind}, row_text bigint, fp bigint, size bigint, prints array<bigint>, bits bigint"), "sketches")


# ---------------------------------------------------------------- candidates
def sketch_keys(prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``prints``, key) for every key of every document; ``prints`` has a row for each (uint64)."""
    flips = np.concatenate(([0], 1 << np.arange(WORD_BITS, dtype=np.int64)))
    words = (prints & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    near = golay_index(words[:, :, None] ^ flips, tables)
    near.sort(axis=2)
    first = np.ones(near.shape, bool)
    first[:, :, 1:] = near[:, :, 1:] != near[:, :, :-1]
    low = (near | np.arange(prints.shape[1], dtype=np.int64)[:, None] << 12).astype(np.uint64)
    keys = (prints >> np.uint64(WORD_BITS) << np.uint64(WORD_BITS))[:, :, None] | low
    return np.nonzero(first)[0], keys[first].view(np.int64)


def key_rows(classes: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                at, keys = sketch_keys(part.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, FINGERPRINTS), tables)
                fps, bits = (part.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps), pa.array(bits)], ["key", "fp", "bits"])

    return classes.select("fp", "bits", "prints").mapInArrow(each, "key bigint, fp bigint, bits bigint")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= LINK_BITS


def _linked(keys: np.ndarray, fps: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within runs of equal keys: short runs all at once, longer ones by search."""
    starts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    small = np.repeat(sizes <= 8, sizes)
    a, b = [fps[:0]], [fps[:0]]
    for step in range(1, min(8, len(keys))):
        at = np.nonzero((keys[step:] == keys[:-step]) & small[step:])[0]
        at = at[_near(bits[at], bits[at + step])]
        a.append(fps[at])
        b.append(fps[at + step])
    for start, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        left = np.arange(start, start + n)
        while len(left) > 1:
            queue, centre, left = [left[0]], fps[left[0]], left[1:]
            while queue and len(left):
                close = _near(bits[left], bits[queue.pop()])
                found, left = left[close], left[~close]
                queue.extend(found)
                a.append(np.full(len(found), centre))
                b.append(fps[found])
    a, b = np.concatenate(a), np.concatenate(b)
    return tuple(np.unique(np.stack((a, b)), axis=1)) if len(a) else (a, b)


def _linker(block: int):
    """Reads rows sorted by key and fp; holds at most ``block`` documents of one key, of longer runs all are linked."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = [np.empty(0, np.int64)] * 3, None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            if over is not None:
                same = held[0] == over[0]
                if same.any():
                    yield out(np.full(same.sum(), over[1]), held[1][same])
                    held = [h[~same] for h in held]
            if not len(held[0]):
                continue
            last = np.searchsorted(held[0], held[0][-1])  # the last key may go on in the next batch
            if last:
                yield out(*_linked(*[h[:last] for h in held]))
                held = [h[last:] for h in held]
            if len(held[0]) > block:
                over = held[0][0], held[1][0]
                yield out(np.full(len(held[1]), over[1]), held[1])
                held = [h[:0] for h in held]
        if len(held[0]):
            yield out(*_linked(*held))

    return each


# ---------------------------------------------------------------- verification
def similar_edges(fps: np.ndarray, sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """Edges that connect all documents linked by pairs of at least that Jaccard similarity; every pair counts."""
    sizes = np.array(list(map(len, sets)))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    different, flat = np.unique(np.concatenate(sets), return_inverse=True)
    left, edges = np.ones(len(fps), bool), []
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        queue, left[seed] = [seed], False
        while queue and left.any():
            i = queue.pop()
            marked = np.zeros(len(different), np.int32)
            marked[flat[starts[i]:starts[i] + sizes[i]]] = 1
            common = np.add.reduceat(marked[flat], starts)
            found = np.nonzero(left & (common * similar[1] >= (sizes + sizes[i] - common) * similar[0]))[0]
            left[found] = False
            queue.extend(found.tolist())
            edges.extend((int(fps[seed]), int(fps[j])) for j in found)
    return edges


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["fp", "hashes"])


def _compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (block, a, b, fp, hashes) sorted by the first three; holds one cell at a time."""
    cell, members = None, {}

    def done() -> pa.RecordBatch:
        fps = np.array(list(members), np.int64)
        edges = similar_edges(fps, [np.frombuffer(x, np.uint64) for x in members.values()]) if len(fps) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for *now, fp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != cell:
                if members:
                    yield done()
                cell, members = now, {}
            members[fp] = hashes
    if members:
        yield done()


def similar_classes(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, block: int = BLOCK, part: int = PART) -> DataFrame:
    """fp, first (the first document with that shingle set: no_id, row_id, row_text) and root, equal within a component.

    ``block`` and ``part`` bound what a task holds; they never decide whether a similar pair among candidates is found."""
    first = F.min(F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "row_text")).alias("first")
    classes = staged(rows.groupBy("fp").agg(first, *[F.any_value(c).alias(c) for c in ("size", "bits", "prints")]), "classes")
    links = staged(key_rows(classes).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linker(block), "a bigint, b bigint"), "links").distinct()
    blocks = components(links).select(F.col("node").alias("fp"), F.col("root").alias("block"))
    members = staged(classes.select("fp", "first", "size").join(blocks, "fp"), "block-members")
    texts = docs.select(F.struct(F.col(id_col).alias("x")).alias("__id"), text_key(F.col(text_col)).alias("__text"), F.col(text_col).cast("binary").alias("text"))
    named = members.select(F.struct(F.col("first.row_id").alias("x")).alias("__id"), F.col("first.row_text").alias("__text"), "fp")
    sets = staged(texts.join(named, ["__id", "__text"]).select("fp", "text").mapInArrow(_shingle_sets, "fp bigint, hashes binary"), "shingle-sets")
    parts = members.groupBy("block").agg(F.ceil(F.sum("size") / part).cast("int").alias("parts"))
    places = members.select("fp", "block").join(parts, "block").withColumn("mine", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    places = places.select("fp", "block", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = sets.join(places.select("fp", "block", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")), "fp")
    cells = cells.select("block", "a", "b", "fp", "hashes").repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")
    roots = components(staged(cells.mapInArrow(_compare_cells, "a bigint, b bigint"), "similar")).select(F.col("node").alias("fp"), "root")
    return classes.select("fp", "first").join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of similar ones, the one with the smallest id, with all columns; of several texts
    under that id one.

    Components are told apart by their shingle sets, never by ids.  Rows without an id come after all others.  Null and
    empty texts and texts without a word are alike; a text shorter than a shingle is one shingle.  An empty table gives
    no rows."""
    rows = sketch_rows(docs, id_col, text_col)
    kept = similar_classes(docs, rows, id_col, text_col).groupBy("root").agg(F.min("first").alias("first"))
    return keep_first(docs, rows, kept.select("first.row_id", "first.row_text"), {"row_id": F.col(id_col), "row_text": text_key(F.col(text_col))})
