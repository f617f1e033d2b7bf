"""Ranked lexical search (13): accumulator-limited scoring, term at a time.

A term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's length factor m = 25 + (75 n N) div L, and a
document scores the sum of w * ((10^9 tf) div (1000 tf + 8 m)) over the terms of an item, repeats included.

Documents are divided among tasks, each with its own postings of the items' terms.  A task takes an item's terms rarest
first.  A document gets an accumulator when one of its terms comes up, until the greatest score that the terms still to come
could give falls below the k-th score so far: no new document can then be among the best.  Accumulators that exist are
updated to their exact scores.  The k best of every task are merged by a ranked window, so postings never move.

Items are searched in blocks with a bounded number of terms (``BLOCK_TERMS``), each block against all documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

TOP = 10
#: Terms of a block of items, repeats in different items counted; an item with more is a block of its own or shares one.
BLOCK_TERMS = 1 << 17
#: Postings and documents that a task holds at a time.
SLICE_POSTINGS = 1 << 21
SLICE_DOCS = 1 << 16

#: Bytes of a term stay, A-Z in lower case; all others become spaces.  Bytes of non-ASCII characters are part of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


# ---------------------------------------------------------------- items
def item_terms(items: DataFrame) -> DataFrame:
    """(qid, term, times) of a table of (qid, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(terms_of(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["qid", "term", "times"])

    return items.select("qid", F.col("text").cast("binary")).mapInArrow(each, "qid bigint, term binary, times bigint")


# ---------------------------------------------------------------- postings
def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, number of terms, and numbers and counts of the vocabulary's terms, for every row with a term; written once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            n, at, terms, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                tokens = terms_of(text.as_py())
                if not tokens:
                    continue
                at.append(i)
                n.append(len(tokens))
                for token, tf in Counter(tokens).items():
                    if (no := known(token)) is not None:
                        terms.append(no)
                        tfs.append(tf)
                ends.append(len(terms))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.int32())),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return staged(rows.mapInArrow(each, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"), "term-vectors")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---------------------------------------------------------------- search
class Slice:
    """Postings of some documents by term, with the greatest share of each term."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, factors: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int):
        self.ids, self.nulls = ids, nulls
        docs = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs, tfs = docs[order], tfs[order]
        self.shares = (1_000_000_000 * tfs) // (1000 * tfs + 8 * factors[self.docs])
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        held = np.nonzero(np.diff(self.starts))[0]
        if len(held):
            self.most[held] = np.maximum.reduceat(self.shares, self.starts[:-1][held])


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def search(part: Slice, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, scores: np.ndarray) -> np.ndarray:
    """Positions of documents that may be among the ``k`` best, with exact scores in ``scores`` (zeros on entry).

    ``terms`` come rarest first with their weights (repeats included); ``floor`` is a score that k documents have already."""
    bounds = np.append(np.cumsum((weights * part.most[terms])[::-1])[::-1], 0).tolist()
    alive, bar, known = None, floor, 0
    for no, (term, weight) in enumerate(zip(terms.tolist(), weights.tolist(), strict=True)):
        start, end = part.starts[term], part.starts[term + 1]
        if alive is None and no:
            # the bar is looked up again only where it can matter: when what is left no longer exceeds the best so far
            if bounds[no] >= bar and known and bounds[no] <= known:
                bar = max(bar, kth(scores[scores > 0], k))
            if bounds[no] < bar:
                alive = np.flatnonzero(scores)
        if start == end:
            continue
        docs = part.docs[start:end]
        if alive is None or len(alive) * 8 > end - start:
            scores[docs] += weight * part.shares[start:end]
            if alive is None:
                known = max(known, int(scores[docs].max()))
        else:
            at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            hit = docs[at] == alive
            scores[alive[hit]] += weight * part.shares[start:end][at[hit]]
    return np.flatnonzero(scores) if alive is None else alive


def best(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id, rows without an id last."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= kth(scores, k))
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], nulls[keep], -scores[keep]))[:k]]


def task_best(vectors: DataFrame, plans: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, n_docs: int, length: int, k: int,
              slice_docs: int = SLICE_DOCS, slice_postings: int = SLICE_POSTINGS) -> DataFrame:
    """(qid, doc_id, score): the k best documents of each item in every task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {qid: (np.empty(0, np.int64),) * 2 + (np.empty(0, bool),) for qid, _, _ in plans}
        held, docs, postings = [], 0, 0

        def flush() -> None:
            ids, nulls, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            factors = np.array([25 + 75 * x * n_docs // length for x in n.tolist()], np.int64)  # whole numbers of any length
            part = Slice(ids, nulls, factors, sizes, terms, tfs, n_terms)
            for qid, own, weights in plans:
                scores = np.zeros(len(ids), np.int64)
                old = top[qid]
                found = search(part, own, weights, k, kth(old[0], k), scores)
                found = found[scores[found] > 0]
                merged = [np.concatenate(x) for x in zip(old, (scores[found], ids[found], nulls[found]), strict=True)]
                pick = best(*merged, k)
                top[qid] = tuple(x[pick] for x in merged)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                ids, n = (piece.column(i) for i in (0, 1))
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                lists = [piece.column(i) for i in (2, 3)]
                sizes = np.diff(lists[0].offsets.to_numpy())
                held.append((ids.fill_null(0).to_numpy(), nulls, n.to_numpy(), sizes, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()))
                docs, postings = docs + piece.num_rows, postings + int(sizes.sum())
                if docs >= slice_docs or postings >= slice_postings:
                    flush()
                    docs = postings = 0
        if held:
            flush()
        for qid, (scores, ids, nulls) in top.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qid, np.int64)), pa.array(ids, mask=nulls), pa.array(scores)], ["qid", "doc_id", "score"])

    return vectors.mapInArrow(each, "qid bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of all ``docs`` for every row of ``items``, those with a score above 0.

    Null and empty texts have no terms and are neither found nor counted.  Repeated documents are ranked one by one, equal
    scores by ascending id, rows without an id last; a repeated item gets its rows again.  Ids are whole numbers.  Very
    long texts count whole; other columns play no part; an empty table on either side gives no rows."""
    spark = docs.sparkSession
    queries = staged(items.select(F.monotonically_increasing_id().alias("qid"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "items")
    wanted = staged(item_terms(queries), "item-terms")
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    found = None
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).collect()  # about block_terms of them
        if not rows:
            continue
        numbers = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        vectors = term_vectors(docs, numbers, id_col, text_col)
        n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        held = {r.term: r["count"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        plans: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows:
            if df := held.get(no := numbers[bytes(r.term)]):
                plans.setdefault(r.qid, []).append((df, no, r.times * term_weight(n_docs, df)))
        ready = []
        for qid, own in plans.items():
            own.sort()
            ready.append((qid, np.array([o[1] for o in own], np.int64), np.array([o[2] for o in own], np.int64)))
        part = task_best(vectors, ready, len(numbers), n_docs, length, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "qid bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")
