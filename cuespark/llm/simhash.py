"""SimHash near-dedup (2) by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect (23, 12) Golay
code, in which every word decodes to exactly one codeword within three errors.  Of at most four differing bits the two
segments with the fewest errors hold at most two together, so for one of the three pairs of segments there is a word of
43 or 42 bits within one bit of both fingerprints.  The keys of a fingerprint are therefore, for each pair, the codeword
indices of the pair itself and of all words one bit away: about 29 keys of 24 bits.  Fingerprints within four bits always
share one; those that share one are compared exactly.

Documents with equal fingerprints are merged before keys are made.  Fingerprints of a key arrive sorted and are compared
inside the task in blocks of bounded size; a task emits, for each group that it finds linked, one edge per member to the
smallest, never all pairs.  A key with more than ``block`` fingerprints goes another exact way: its members get the 2,081
words within two bits of them, and members sharing such a word are within four bits of each other without comparison, so
that a grouped minimum links them in time linear in their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, staged, text_key

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCK = 1 << 15
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a UTF-8 text; zero if it has no word."""
    import xxhash

    tokens = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII white space characters only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """row_id, row_text and the signed fingerprint ``fp`` of every row, written once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["row_id", "row_text", "fp"])

    source = docs.select(F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["row_id"].dataType.simpleString()
    return staged(source.mapInArrow(each, f"row_id {kind}, row_text bigint, fp bigint"), "fingerprints")


# ---------------------------------------------------------------- Golay keys
def _remainders() -> np.ndarray:
    """Remainder modulo the generator of each 12-bit value followed by eleven zeros."""
    out = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _leaders(remainders: np.ndarray) -> np.ndarray:
    """For each syndrome the only error pattern of at most three bits that has it."""
    singles = np.array([1 << b for b in range(23)], np.int64)
    two = singles[:, None] | singles
    patterns = np.unique(np.concatenate(([0], (two[:, :, None] | singles).ravel())))
    out = np.full(1 << 11, -1, np.int64)
    out[remainders[patterns >> 11] ^ (patterns & 0x7FF)] = patterns
    return out


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    remainders = _remainders()
    return remainders, _leaders(remainders)


def golay_index(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    remainders, leaders = tables
    return (words ^ leaders[remainders[words >> 11] ^ (words & 0x7FF)]) >> 11


def golay_keys(prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``prints``, key) for every key of every fingerprint (uint64)."""
    near = []
    for shift, width in SEGMENTS:
        word = (prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        flips = np.concatenate(([0], 1 << np.arange(width, dtype=np.int64)))
        near.append(golay_index(word[:, None] ^ flips, tables))
    places, keys = [], []
    for no, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = np.concatenate((near[i] << 12 | near[j][:, :1], near[i][:, :1] << 12 | near[j]), axis=1)
        both.sort(axis=1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        places.append(np.nonzero(first)[0])
        keys.append(both[first] | no << 24)
    return np.concatenate(places), np.concatenate(keys)


def key_rows(prints: DataFrame) -> DataFrame:
    """(key, fp) rows of a table of distinct fingerprints."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            if batch.num_rows:
                fps = batch.column(0).to_numpy(zero_copy_only=False)
                at, keys = golay_keys(fps.view(np.uint64), tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(fps[at])], ["key", "fp"])

    return prints.select("fp").mapInArrow(each, "key int, fp bigint")


# ---------------------------------------------------------------- links
def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the bits of the magnitude


def _groups(fps: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Groups of two and more fingerprints that are linked among themselves, by breadth-first search over what is left."""
    left = fps
    while len(left) > 1:
        queue, left, members = [left[0]], left[1:], [left[0]]
        while queue and len(left):
            close = _distance(left, queue.pop()) <= bits
            if close.any():
                found, left = left[close], left[~close]
                queue.extend(found)
                members.extend(found)
        if len(members) > 1:
            yield np.array(members, fps.dtype)


def _star(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = members.min()
    rest = members[members != low]
    return rest, np.full(len(rest), low, rest.dtype)


def _compare(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the fingerprints of equal keys (sorted): short runs all at once, longer ones one by one."""
    starts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    a, b = [], []
    small = np.repeat(sizes <= 8, sizes)
    for step in range(1, 8):
        if len(keys) <= step:
            break
        close = (keys[step:] == keys[:-step]) & small[step:]
        at = np.nonzero(close)[0]
        at = at[_distance(fps[at], fps[at + step]) <= bits]
        a.append(fps[at + step])
        b.append(fps[at])
    for i, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        for members in _groups(fps[i:i + n], bits):
            hi, lo = _star(members)
            a.append(hi)
            b.append(lo)
    if not a:
        return fps[:0], fps[:0]
    return np.concatenate(a), np.concatenate(b)


def _linker(bits: int, block: int):
    """Reads rows sorted by key; holds the fingerprints of one key at most, up to ``block`` of them."""

    def out(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        if not crowded and len(a):
            a, b = np.unique(np.stack((a, b)), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], ["a", "b", "crowded"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.empty(0, np.int32), np.empty(0, np.int64), None
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False)))
            if over is not None:
                same = keys == over
                if same.any():
                    yield out(fps[same], fps[same], True)
                    keys, fps = keys[~same], fps[~same]
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            sizes = last and np.unique(keys[:last], return_counts=True)
            if last:
                long = sizes[0][sizes[1] > block]
                held = np.isin(keys[:last], long)
                if held.any():
                    yield out(fps[:last][held], fps[:last][held], True)
                yield out(*_compare(keys[:last][~held], fps[:last][~held], bits), False)
            keys, fps = keys[last:], fps[last:]
            if len(keys) > block:
                over = keys[0]
                yield out(fps, fps, True)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield out(*_compare(keys, fps, bits), False)

    return each


def _within_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    flips = np.unique(one[:, None] ^ one)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 256):
            part = fps[at:at + 256]
            words = (part.view(np.uint64)[:, None] ^ flips).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.ravel()), pa.array(np.repeat(part, len(flips)))], ["word", "fp"])


def link_prints(prints: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose connected components are those of all links of at most ``bits`` bits.

    ``block`` bounds what a task holds of one key; it decides how, never whether, a link is found."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the segments and keys hold for 0 to {MAX_BITS} bits")
    rows = key_rows(prints).repartition("key").sortWithinPartitions("key")
    found = staged(rows.mapInArrow(_linker(bits, block), "a bigint, b bigint, crowded boolean"), "links")
    edges = found.filter("not crowded").select("a", "b").distinct()
    crowd = found.filter("crowded").select(F.col("a").alias("fp")).distinct()
    if not crowd.limit(1).count():
        return edges
    if bits != MAX_BITS:  # words within half the bits of both decide only for an even number; compare what shares one
        raise ValueError(f"keys with more than {block} fingerprints are linked for {MAX_BITS} bits only; raise block")
    words = crowd.mapInArrow(_within_two, "word bigint, fp bigint")
    low = words.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return edges.unionByName(words.join(low, "word").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def group_prints(rows: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Adds component_id, the smallest row_id reachable, to ``fingerprint_rows``."""
    classes = staged(rows.groupBy("fp").agg(F.min("row_id").alias("rep"), F.count("*").alias("n")), "classes")
    joined = components(link_prints(classes.select("fp"), bits, block)).select(F.col("node").alias("fp"), "root")
    with_root = classes.join(joined, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    with_root = staged(with_root, "roots")
    linked = with_root.join(joined.select("root").distinct(), "root", "left_semi")
    best = linked.groupBy("root").agg(F.min("rep").alias("low"))
    facts = staged(with_root.join(best, "root", "left").select("fp", "n", F.coalesce("low", "rep").alias("component_id")), "component-facts")
    return attach(rows, facts, "fp", "n").select("row_id", "row_text", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    A null text counts as empty; texts without a word have fingerprint zero and are linked like any other.  Texts shorter
    than a shingle are one shingle.  Repeated rows are all returned.  A component of rows that all lack an id has a null
    component_id.  Very long texts are hashed in blocks; other columns play no part; an empty table gives no rows."""
    grouped = group_prints(fingerprint_rows(docs, id_col, text_col))
    return grouped.select(F.col("row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
