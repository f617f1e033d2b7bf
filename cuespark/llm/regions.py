"""N-gram Jaccard join (12): a metric-space join of shingle sets at a distance of at most 0.15.

Jaccard distance is a metric.  A region of documents is joined by pivots: every document gets its distance to each pivot and
belongs to the Voronoi cell of the nearest.  A document x at distance d(x, p) of its own pivot p can be linked with one of
pivot q's cell only if d(x, q) <= d(x, p) + 2 r, so it is repeated in the cells within that window.  Documents within r of
a pivot are linked with it, and so with each other; of these a cell keeps only the ring that documents outside can reach.
Cells are joined in the same way, down to a few documents that are compared directly.  Regions too large for a task are
split into cells by many tasks (``split_regions``), others within one (``Region``).

Unrelated documents lie at a distance of nearly 1 from every pivot, so the windows of cells over the whole table would hold
everything.  The first regions therefore come from single shingles: of sets that are linked, the first 15 % in any common
order share one.  The order is by rising frequency, from counts of all shingles in 2^20 buckets.  Within such a region, those
are tied together whose sizes and counts of shingles in 64 classes, or more for long sets, allow a link (both are exact bounds); what is tied
together, over all shingles, is a first region."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, components, staged, text_key

SHINGLE_WORDS = 4
#: Least similarity of linked documents in hundredths, and the distance that goes with it.
PERCENT = 85
RADIUS = 1 - PERCENT / 100
SEED = 42
#: Counting buckets of shingles, buckets of a row in which counts travel, classes of a signature, bits of a filter.
BUCKET_BITS = 20
FILTER_BITS = 22
SLICE = 1 << 12
CLASSES = 64
#: Documents of one shingle that a task compares; those of a more frequent one are all tied together.
RUN = 1 << 15
#: Shingles of a region that one task joins.
PART = 1 << 20
PIVOTS = 64
LEAF = 12
#: A cell of a region at least this large, in hundredths, is compared directly.
STUCK = 70
_SLACK = 1e-9


# ---------------------------------------------------------------- sets
def shingle_set(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted different hashes of a text's shingles; with fewer words the whole sequence is one, without a word there is none."""
    tokens = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII white space characters only
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[i:j], SEED) for i, j in spans), np.uint64, n))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def signature(hashes: np.ndarray) -> bytes:
    """Shingles in each of the classes; what two differ by is the least size of the sets' difference."""
    return np.minimum(np.bincount((hashes & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def long_signature(hashes: np.ndarray) -> bytes | None:
    """As ``signature`` in more classes, a power of two of about a sixteenth of the set's size; null for short sets."""
    if len(hashes) <= 16 * CLASSES:
        return None
    classes = 1 << ((len(hashes) - 1) // 16).bit_length()
    return np.minimum(np.bincount((hashes & np.uint64(classes - 1)).astype(np.int64), minlength=classes), 65535).astype(np.uint16).tobytes()


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def set_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, row_text, fp, size, signature, long_signature) of all documents, and (slice, counts) of their shingles; one pass.

    A set that a task meets again is counted once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << BUCKET_BITS, np.int64), set()
        names = ["row_id", "row_text", "fp", "size", "signature", "long_signature", "slice", "counts"]
        kind = None
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            kind = batch.column(0).type
            fps = [set_id(s) for s in sets]
            new = []
            for fp, s in zip(fps, sets, strict=True):
                if fp not in seen:
                    seen.add(fp)
                    new.append(s)
            if new:
                counts += np.bincount(buckets(np.concatenate(new)), minlength=len(counts))
            n = len(sets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(signature, sets)), pa.binary()),
                                              pa.array(list(map(long_signature, sets)), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if kind is not None:
            parts = counts.reshape(-1, SLICE)
            held = np.flatnonzero(parts.any(axis=1))
            n = len(held)
            if n:
                yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())), pa.array(held.astype(np.int32)),
                                                  pa.array([zlib.compress(parts[i].tobytes(), 1) for i in held], pa.binary())], names)

    source = docs.select(F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["row_id"].dataType.simpleString()
    both = staged(source.mapInArrow(each, f"row_id {kind}, row_text bigint, fp bigint, size bigint, signature binary, long_signature binary, slice int, counts binary"), "shingle-sets")
    return both.filter("slice is null").drop("slice", "counts"), both.filter("slice is not null").select("slice", "counts")


def bucket_counts(slices: DataFrame) -> np.ndarray:
    """Counts of all buckets: 2^20 numbers, whatever the table's size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for no, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if no != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "counts"])
                    now, total = no, np.zeros(SLICE, np.int64)
                total += np.frombuffer(zlib.decompress(counts), np.int64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    out = np.zeros((1 << BUCKET_BITS) // SLICE * SLICE, np.int64).reshape(-1, SLICE)
    for row in slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(each, "slice int, counts binary").collect():
        out[row.slice] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    return out.ravel()


# ---------------------------------------------------------------- regions of single shingles
def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set by rising frequency, one of which every linked set has among its own first, without
    those that no other set has."""
    n = len(hashes)
    keep = n - -(-PERCENT * n // 100) + 1
    often = counts[buckets(hashes)]
    order = np.lexsort((hashes, often))[:keep]
    return hashes[order[often[order] > 1]]


def key_rows(spark: SparkSession, docs: DataFrame, text_col: str, counts: np.ndarray) -> DataFrame:
    shared = spark.sparkContext.broadcast(counts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, fps = [], []
            for text in batch.column(0):
                hashes = shingle_set(text.as_py())
                fp = set_id(hashes)
                if fp not in seen:
                    seen.add(fp)
                    keys.append(prefix(hashes, shared.value))
                    fps.append(np.full(len(keys[-1]), fp))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps))], ["key", "fp"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(each, "key bigint, fp bigint")


def _runs(run: int):
    """Rows sorted by key and fp to (region, fp) of keys with several sets, equal groups once; ``region`` is a hash of the
    group, of the key where it has more than ``run`` sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over, seen = np.empty(0, np.int64), np.empty(0, np.int64), None, set()

        def out(region: int, members: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(members), region)), pa.array(members)], ["region", "fp"])

        def ended(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
            keys, fps = keys[first], fps[first]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            regions, members = [], []
            for start, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                own = fps[start:start + n]
                region = set_id(own)
                if region not in seen:
                    seen.add(region)
                    regions.append(np.full(n, region))
                    members.append(own)
            if regions:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(regions)), pa.array(np.concatenate(members))], ["region", "fp"])

        for batch in batches:
            keys, fps = (np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip((keys, fps), batch.columns, strict=True))
            if over is not None:
                same = keys == over
                if same.any():
                    yield out(over, fps[same])
                    keys, fps = keys[~same], fps[~same]
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            if last:
                yield from ended(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if len(keys) > run:
                over = keys[0]
                yield out(over, fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from ended(keys, fps)

    return each


def _may_link(sizes: np.ndarray, signs: np.ndarray, size: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Whether sizes and signatures allow the similarity: 100 common >= 85 union, with common at most (sum - difference) / 2."""
    total = sizes + size
    apart = np.abs(signs.astype(np.int16) - sign).sum(axis=-1, dtype=np.int64)
    return (100 * np.minimum(sizes, size) >= PERCENT * np.maximum(sizes, size)) & ((100 - PERCENT) * total >= (100 + PERCENT) * apart)


def _may_link_long(total: int, a: bytes, b: bytes) -> bool:
    """The same bound by the signatures of two long sets, in the classes of the one that has fewer."""
    x, y = (np.frombuffer(s, np.uint16).astype(np.int64) for s in (a, b))
    classes = min(len(x), len(y))
    x, y = (z.reshape(-1, classes).sum(axis=0) for z in (x, y))
    # a full class may hold more than it counts: leave those out
    open_ = (x < 65535) & (y < 65535)
    return (100 - PERCENT) * total >= (100 + PERCENT) * int(np.abs(x - y)[open_].sum())


def _tied(run: int):
    """Rows (region, fp, size, signature, long_signature) sorted by region and fp to edges that tie together what may be
    linked."""

    def ties(regions: np.ndarray, fps: np.ndarray, sizes: np.ndarray, signs: np.ndarray, longs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def hold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Of pairs of positions that may be linked, those that long signatures leave."""
            long = np.flatnonzero(np.minimum(sizes[a], sizes[b]) > 16 * CLASSES)
            keep = np.ones(len(a), bool)
            for i in long.tolist():
                keep[i] = _may_link_long(int(sizes[a[i]] + sizes[b[i]]), longs[a[i]], longs[b[i]])
            return keep

        starts = np.flatnonzero(np.concatenate(([True], regions[1:] != regions[:-1])))
        lengths = np.diff(np.append(starts, len(regions)))
        small = np.repeat(lengths <= 8, lengths)
        a, b = [fps[:0]], [fps[:0]]
        for step in range(1, min(8, len(fps))):
            at = np.flatnonzero((regions[step:] == regions[:-step]) & small[step:])
            at = at[_may_link(sizes[at], signs[at], sizes[at + step], signs[at + step])]
            at = at[hold(at, at + step)]
            a.append(fps[at])
            b.append(fps[at + step])
        for start, n in zip(starts[lengths > 8].tolist(), lengths[lengths > 8].tolist(), strict=True):
            left = start + np.argsort(sizes[start:start + n], kind="stable")
            while len(left) > 1:
                queue, centre, left = [left[0]], fps[left[0]], left[1:]
                while queue and len(left):
                    i = queue.pop()
                    low = np.searchsorted(sizes[left], -(-PERCENT * sizes[i] // 100))
                    high = np.searchsorted(sizes[left], 100 * sizes[i] // PERCENT, "right")
                    near = np.zeros(len(left), bool)
                    near[low:high] = _may_link(sizes[left[low:high]], signs[left[low:high]], sizes[i], signs[i])
                    close = np.flatnonzero(near)
                    near[close] = hold(left[close], np.full(len(close), i))
                    found, left = left[near], left[~near]
                    queue.extend(found.tolist())
                    a.append(np.full(len(found), centre))
                    b.append(fps[found])
        return np.concatenate(a), np.concatenate(b)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, None
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            """The edges that tie together what the task's edges so far do not."""
            new = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                rx, ry = root(x), root(y)
                if rx != ry:
                    above[rx] = ry
                    new.append((x, y))
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in new], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, CLASSES))
            now.append(np.array([*batch.column(4).to_pylist(), b""], object)[:-1])
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if over is not None:
                same = held[0] == over[0]
                if same.any():
                    yield out(np.full(same.sum(), over[1]), held[1][same])
                    held = [h[~same] for h in held]
            if not len(held[0]):
                continue
            last = np.searchsorted(held[0], held[0][-1])
            if last:
                yield out(*ties(*(h[:last] for h in held)))
                held = [h[last:] for h in held]
            if len(held[0]) > run:
                over = held[0][0], held[1][0]
                yield out(np.full(len(held[1]), over[1]), held[1])
                held = [h[:0] for h in held]
        if held is not None and len(held[0]):
            yield out(*ties(*held))

    return each


# ---------------------------------------------------------------- metric join within a task
class Region:
    """Sets of a region; ``links`` are pairs of positions whose components are those of all links among the sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array(list(map(len, sets)), np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        different, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.mark = np.zeros(len(different), bool)
        self.label = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.starts[one]:self.starts[one + 1]]
        self.mark[own] = True
        sizes = self.sizes[others]
        offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.repeat(self.starts[others] - offsets, sizes) + np.arange(sizes.sum())
        out = np.add.reduceat(self.mark[self.flat[at]], offsets, dtype=np.int64)
        self.mark[own] = False
        return out

    def compare(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances, and which are linked; the links are taken up."""
        common = self.common(one, others)
        union = self.sizes[others] + self.sizes[one] - common
        linked = 100 * common >= PERCENT * union
        for other in others[linked].tolist():
            if self.label[other] != self.label[one]:
                self.label[self.label == self.label[other]] = self.label[one]
                self.links.append((one, other))
        return 1 - common / union, linked

    def direct(self, members: np.ndarray) -> None:
        """Every pair not yet connected."""
        while len(members) > 1:
            one, members = int(members[0]), members[1:]
            others = members[self.label[members] != self.label[one]]
            if len(others):
                self.compare(one, others)

    def join(self, members: np.ndarray, pivots: int = 8) -> None:
        """Pivots, Voronoi cells with their windows, and the cells in turn."""
        if len(members) <= LEAF or (self.label[members] == self.label[members[0]]).all():
            self.direct(members)
            return
        distance, linked = [], []
        free = np.ones(len(members), bool)  # not within twice the radius of a pivot
        while len(distance) < pivots and free.any():
            d, near = self.compare(int(members[np.argmax(free)]), members)
            distance.append(d)
            linked.append(near)
            free &= d > 2 * RADIUS
        for inside in cells(np.array(distance).T, np.array(linked).T):
            cell = members[inside]
            if len(cell) * 100 < STUCK * len(members):
                self.join(cell, pivots)
            else:
                self.direct(cell)


def cells(distance: np.ndarray, linked: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of each cell's members that still have to be joined: its own, repeated ones, and of those linked with the
    pivot only the ring in reach of the others.  A pair of two cells meets in the first of them."""
    home = distance.argmin(axis=1)
    best = distance[np.arange(len(home)), home]
    for j in range(distance.shape[1]):
        own, d = home == j, distance[:, j]
        reach = d[own].max(initial=-1.0) + RADIUS
        inside = own | ((home > j) & (d <= best + 2 * RADIUS + _SLACK) & (d <= reach + _SLACK))
        outer = inside & ~linked[:, j]
        if outer.any():
            yield np.flatnonzero(inside & (~linked[:, j] | (d >= d[outer].min() - RADIUS - _SLACK)))


def _join_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, fp, hashes) sorted by region to links; one region is held at a time."""
    now, held, started = None, {}, False

    def done() -> pa.RecordBatch:
        fps = list(held)
        region = Region([np.frombuffer(x, np.uint64) for x in held.values()])
        region.join(np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array([fps[link[i]] for link in region.links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for name, fp, hashes in _rows(batches):
        if name != now or not started:
            if len(held) > 1:
                yield done()
            now, held, started = name, {}, True
        held[fp] = hashes
    if len(held) > 1:
        yield done()


# ---------------------------------------------------------------- metric join over tasks
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Python values, made for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, fp, hashes) of possible pivots, sorted by region, to those further than twice the radius from all
    chosen before them: pivots side by side would repeat a whole group in the cell of each."""
    now, held, started = None, {}, False

    def done() -> pa.RecordBatch:
        fps, region = list(held), Region([np.frombuffer(x, np.uint64) for x in held.values()])
        left, chosen = np.arange(len(fps)), []
        while len(left):
            chosen.append(int(left[0]))
            left = left[1:][region.compare(chosen[-1], left[1:])[0] > 2 * RADIUS] if len(left) > 1 else left[1:]
        return pa.RecordBatch.from_arrays([pa.array([now] * len(chosen), pa.int64()), pa.array([fps[i] for i in chosen], pa.int64())], ["region", "fp"])

    for region, fp, hashes in _rows(batches):
        if region != now or not started:
            if held:
                yield done()
            now, held, started = region, {}, True
        held[fp] = hashes
    if held:
        yield done()


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, part, pivot, fp, hashes) sorted by region, part and pivots first: each set in the cell of its nearest
    pivot and in those within the window, and which pivots it is linked with."""
    now, fps, sets, members, size = None, [], [], [], 0

    def done() -> pa.RecordBatch:
        region = Region(sets + [np.frombuffer(x, np.uint64) for _, x in members])
        own = np.arange(len(sets), len(sets) + len(members))
        found = [region.compare(i, own) for i in range(len(sets))]
        distance, linked = np.array([d for d, _ in found]).T, np.array([x for _, x in found]).T
        home = distance.argmin(axis=1)
        inside = (distance <= distance.min(axis=1)[:, None] + 2 * RADIUS + _SLACK) & (np.arange(len(sets)) <= home[:, None])
        at, cell = np.nonzero(inside | linked)
        rows = [[now[0]] * len(at), [fps[c] for c in cell], [members[i][0] for i in at], linked[at, cell].tolist(), distance[at, cell].tolist(), (home[at] == cell).tolist(), inside[at, cell].tolist()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.bool_(), pa.bool_()]
        members.clear()
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["region", "cell", "fp", "linked", "distance", "own", "inside"])

    for region, part, pivot, fp, hashes in _rows(batches):
        if now != (region, part):
            if members:
                yield done()
            now, fps, sets, size = (region, part), [], [], 0
        if pivot:
            fps.append(fp)
            sets.append(np.frombuffer(hashes, np.uint64))
        else:
            members.append((fp, hashes))
            size += len(hashes)
            if len(members) >= 512 or size >= 1 << 23:
                yield done()
                size = 0
    if members:
        yield done()


def split_regions(rows: DataFrame, large: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """Links with pivots (a, b), and (region, fp, size, hashes, parent) of the cells of ``large`` regions that are still to
    be joined.  ``large`` has region, sets and total (their shingles)."""
    mine = rows.join(large.withColumn("parts", F.ceil(F.col("total") / part).cast("int")), "region")
    draw = F.shiftright(F.xxhash64("region", "fp"), 1).cast("double") / float(1 << 62)  # uniform between -1 and 1
    share = F.least(F.lit(PIVOTS), 4 * F.col("parts")) / F.col("sets")
    first = mine.groupBy("region").agg(F.min("fp").alias("first"))
    possible = mine.join(first, "region").filter((F.abs(draw) < share) | (F.col("fp") == F.col("first"))).select("region", "fp", "hashes")
    chosen = staged(possible.repartition("region").sortWithinPartitions("region", F.xxhash64("fp")).mapInArrow(_apart, "region bigint, fp bigint"), "pivots")
    columns = ["region", "part", "pivot", "fp", "hashes"]
    members = mine.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("pivot", F.lit(False)).select(*columns)
    pivots = mine.join(chosen, ["region", "fp"]).withColumn("pivot", F.lit(True)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*columns)
    placed = members.unionByName(pivots).repartition("region", "part").sortWithinPartitions("region", "part", F.desc("pivot"), "fp")
    kind = "region bigint, cell bigint, fp bigint, linked boolean, distance double, own boolean, inside boolean"
    assigned = staged(placed.mapInArrow(_assign, kind), "cells")
    links = assigned.filter("linked").select(F.col("cell").alias("a"), F.col("fp").alias("b"))
    near = assigned.filter("inside")
    outer = near.filter("not linked").groupBy("region", "cell").agg(F.min("distance").alias("outer"))
    reach = near.filter("own").groupBy("region", "cell").agg((F.max("distance") + RADIUS + _SLACK).alias("reach"))
    left = near.join(reach, ["region", "cell"]).filter(F.col("own") | (F.col("distance") <= F.col("reach")))
    left = left.join(outer, ["region", "cell"]).filter(~F.col("linked") | (F.col("distance") >= F.col("outer") - RADIUS - _SLACK))
    cell = left.join(rows, ["region", "fp"]).select(F.xxhash64("region", "cell").alias("region"), "fp", "size", "hashes", F.col("region").alias("parent"))
    return links, cell


def region_links(rows: DataFrame, part: int = PART) -> DataFrame:
    """Links (a, b) of (region, fp, size, hashes) whose components are those of all links within regions."""
    total = rows.groupBy("region").agg(F.sum("size").alias("total"), F.count("*").alias("sets"))
    totals = staged(total.filter("sets > 1"), "regions")
    links, parents = None, None
    while True:
        large = totals.filter(F.col("total") > part)
        small = rows.join(large.select("region"), "region", "left_anti")
        found = small.select("region", "fp", "hashes").repartition("region").sortWithinPartitions("region", "fp").mapInArrow(_join_regions, "a bigint, b bigint")
        found = staged(found, "links")
        links = found if links is None else links.unionByName(found)
        if parents is not None:  # cells that are hardly smaller than what they were cut from
            stuck = large.join(parents, "region").filter(F.col("total") * 100 >= F.col("parent_total") * STUCK).select("region", "total")
            links = links.unionByName(_direct_links(rows, stuck, part))
            large = large.join(stuck.select("region"), "region", "left_anti")
        if not large.limit(1).count():
            return links
        near, cell = split_regions(rows, large, part)
        links = links.unionByName(near)
        up = large.select(F.col("region").alias("parent"), F.col("total").alias("parent_total"))
        rows = staged(cell, "cells")
        sums = rows.groupBy("region").agg(F.sum("size").alias("total"), F.count("*").alias("sets"), F.min("parent").alias("parent"))
        sums = staged(sums.filter("sets > 1").join(up, "parent"), "regions")
        totals, parents = sums.select("region", "total", "sets"), sums.select("region", "parent_total")


def _direct_links(rows: DataFrame, stuck: DataFrame, part: int) -> DataFrame:
    """Regions that pivots do not divide: every two parts meet in a task of their own."""
    parts = stuck.select("region", (F.ceil(2 * F.col("total") / part)).cast("int").alias("parts"))
    places = rows.join(parts, "region").withColumn("mine", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    places = places.select("region", "fp", "hashes", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    places = places.select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "fp", "hashes")
    return staged(places.repartition("region").sortWithinPartitions("region", "fp").mapInArrow(_join_regions, "a bigint, b bigint"), "links")


# ---------------------------------------------------------------- operator
def member_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(region, fp, size, hashes) of the documents that ``members`` names.

    A filter of 2^22 bits on the texts' hashes goes to all tasks, so that few other documents are hashed and moved."""
    bit = F.pmod("first.row_text", F.lit(1 << FILTER_BITS))
    words = members.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    bits = np.zeros(1 << FILTER_BITS >> 6, np.int64)
    for row in words.collect():
        bits[row.word] = row.bits
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(shared.value[batch.column(1).to_numpy() & ((1 << FILTER_BITS) - 1)])
            for at in range(0, len(some), 512):
                part = batch.take(pa.array(some[at:at + 512]))
                sets = [shingle_set(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "key", "size", "hashes"])

    source = docs.select(F.struct(F.col(id_col).alias("x")).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    found = source.mapInArrow(each, f"id {source.schema['id'].dataType.simpleString()}, key bigint, size bigint, hashes binary")
    named = members.select(F.struct(F.col("first.row_id").alias("x")).alias("id"), F.col("first.row_text").alias("key"), "region", "fp")
    return found.join(named, ["id", "key"]).select("region", "fp", "size", "hashes")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, part: int = PART) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links of at least 85 % reach, of every row of ``docs``.

    Rows without a word, null texts among them, have an empty set and are linked with nothing: each is its own component.
    Rows with equal sets are linked.  A component of rows that all lack an id has a null component_id.  Repeated rows are all
    returned; very long texts count whole; other columns play no part; an empty table gives no rows.  ``run`` and ``part``
    bound what a task holds; they decide how, never whether, a link is found."""
    spark = docs.sparkSession
    rows, slices = set_rows(docs, id_col, text_col)
    classes = staged(rows.filter("size > 0").groupBy("fp").agg(F.min(F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "row_text")).alias("first"), F.count("*").alias("n"),
                                                               *[F.any_value(c).alias(c) for c in ("size", "signature", "long_signature")]), "classes")
    keys = key_rows(spark, docs, text_col, bucket_counts(slices)).repartition("key").sortWithinPartitions("key", "fp")
    groups = staged(keys.mapInArrow(_runs(run), "region bigint, fp bigint"), "key-regions")
    marks = ["fp", "size", "signature", "long_signature"]
    signed = groups.join(classes.select(*marks), "fp").select("region", *marks)
    ties = staged(signed.repartition("region").sortWithinPartitions("region", "fp").mapInArrow(_tied(run), "a bigint, b bigint"), "ties")
    tied = components(ties).select(F.col("node").alias("fp"), F.col("root").alias("region"))
    members = staged(classes.select("fp", "first", "size").join(tied, "fp"), "members")
    sets = staged(member_sets(docs, members, id_col, text_col), "sets")
    joined = components(region_links(sets, part)).select(F.col("node").alias("fp"), "root")
    with_root = staged(classes.select("fp", F.col("first.row_id").alias("rep"), "n").join(joined, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "roots")
    best = with_root.join(joined.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("low"))
    facts = staged(with_root.join(best, "root", "left").select("fp", "n", F.coalesce("low", "rep").alias("component_id")), "component-facts")
    some = attach(rows.filter("size > 0"), facts, "fp", "n").select("row_id", "size", "component_id")
    out = some.unionByName(rows.filter("size = 0").select("row_id", "size", F.col("row_id").alias("component_id")))
    return out.select(F.col("row_id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")
