"""Ranked search against brute force over whole tables and odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from cuespark.llm import ranked
from cuespark.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def naive(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        wanted = Counter(terms(text))
        for d, b, n in bags:
            m = 100 - 75 + 75 * n * n_docs // length
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in wanted.items() if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def rows_of(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = QUERIES["op13_ranked_search"](spark, sf)
    assert got.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == naive(docs, items)


def test_blocks_ties_and_odd_rows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "a_b", "x-Y"]
    docs = [(i, " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(1, 30)))) for i in range(400)]
    docs += [(500 + i, "w1 w2 w3") for i in range(40)] + [(None, "w1 w2 w3"), (None, None), (7, None), (8, ""), (9, "_-_"), (3, "w1 w2 w3"), (3, "w1 w2 w3"), (600, "w5 " * 100_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)] + [(30, "w1 w2 w3"), (30, "w1 w2 w3"), (31, None), (None, "w5 w5 W1"), (32, ""), (33, "unheard of")]
    rng.shuffle(docs)
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, text string, qid string, score int")
    q = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, doc_id string")
    want = naive(docs, items)
    assert rows_of(ranked.rank_documents(d, q)) == want
    assert rows_of(ranked.rank_documents(d.repartition(7), q, block_terms=40)) == want  # several blocks of items
    assert rows_of(ranked.rank_documents(d, q, k=3)) == naive(docs, items, 3)
    assert ranked.rank_documents(d.limit(0), q).count() == 0 and ranked.rank_documents(d, q.limit(0)).count() == 0


def test_accumulators_are_limited():
    """Creation stops once what is left cannot reach the k-th score, and the best stay exact."""
    rng = np.random.default_rng(1)
    n, held = 2000, [5, 40, 1900]
    docs = [np.sort(rng.choice(n, c, replace=False)) for c in held]
    flat, sizes = np.concatenate(docs), np.bincount(np.concatenate(docs), minlength=n)
    order = np.argsort(flat, kind="stable")
    numbers = np.repeat(np.arange(3), held)[order]
    part = ranked.Slice(np.arange(n), np.zeros(n, bool), np.full(n, 100), sizes, numbers, np.ones(len(flat), np.int64), 3)
    weights, scores = np.array([9000, 7000, 10]), np.zeros(n, np.int64)
    found = ranked.search(part, np.arange(3), weights, 5, 0, scores)
    assert len(found) < 50
    full = np.zeros(n, np.int64)
    for t in range(3):
        full[docs[t]] += weights[t] * (10**9 // 1800)
    nulls = np.zeros(n, bool)
    want = ranked.best(full, np.arange(n), nulls, 5)
    assert found[ranked.best(scores[found], found, nulls[found], 5)].tolist() == want.tolist() and (scores[want] == full[want]).all()
