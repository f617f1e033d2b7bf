"""Exact and near duplicates against brute force, and the digest index over several batches."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from cuespark.llm import exact_dedup, simhash
from cuespark.llm.common import components, new_path

SCHEMA = "doc_id bigint, text string, lang string, source string, digest int, fp string, row_id string"
ODD = [
    (1, "a  b\tc", "en", "s", 1, "x", "y"), (2, "a b c", None, None, None, None, None), (3, None, "en", "s", 1, "x", "y"), (4, "", "en", "s", 1, "x", "y"),
    (5, " ", "en", "s", 1, "x", "y"), (2, "a b c", None, None, None, None, None), (None, "a b c", "en", "s", 1, "x", "y"), (6, "word " * 200_000, "en", "s", 1, "x", "y"),
    (7, "a b c", "en", "s", 1, "x", "y"), (None, "only here", "en", "s", 1, "x", "y"),
]


def hex_of(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def naive_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_roots(values, bits=4):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_exact_odd_rows(spark):
    rows = exact_dedup.mark_copies(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.text_sha256 for r in rows) == sorted(hex_of(r[1]) for r in ODD)
    same = [r for r in rows if r.text_sha256 == hex_of("a b c")]
    assert {(r.keep_id, r.group_size) for r in same} == {(1, 4)} and [r.doc_id for r in same if r.kept] == [1]
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows if r.text_sha256 == hex_of("")} == {(3, 3, True), (4, 3, False)}
    kept = exact_dedup.drop_copies(spark.createDataFrame(ODD, SCHEMA))
    assert kept.columns == spark.createDataFrame(ODD, SCHEMA).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 6, 7]
    twice = spark.createDataFrame([ODD[1], ODD[1]], SCHEMA)
    assert exact_dedup.drop_copies(twice).count() == 1 and exact_dedup.mark_copies(twice).filter("kept").count() == 1
    assert exact_dedup.mark_copies(twice.limit(0)).count() == 0


def test_index_over_batches(spark):
    folder = new_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, folder, buckets=4)
    one = spark.createDataFrame([(10, "x y"), (11, "z")], "doc_id bigint, text string")
    two = spark.createDataFrame([(1, "x  y"), (2, "new"), (3, "new")], "doc_id bigint, text string")
    assert exact_dedup.drop_copies(one, index).count() == 2
    again = exact_dedup.DigestIndex(spark, folder, buckets=4)
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.mark_copies(two, again).collect()} == {(1, 10, False), (2, 2, True), (3, 2, False)}
    assert exact_dedup.drop_copies(two, again).count() == 0 and again.read().count() == 3
    plan = two.selectExpr("unhex(sha2(text, 256)) AS digest").hint("merge").join(again.read(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_fingerprints_and_components(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    prints = [naive_print(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[r] for r in naive_roots(prints)]


@pytest.mark.parametrize("block", [1 << 15, 5])
def test_links_lose_nothing(spark, block):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)] + [0, 1, 2**64 - 1]
    for base in values[:12]:
        for n in (1, 2, 3, 4, 4, 5, 6, 8):
            values.append(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    values = sorted(set(values))
    table = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint")
    got = {r.node: r.root for r in components(simhash.link_prints(table, block=block)).collect()}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    want = naive_roots(values)
    groups = {}
    for v, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(v)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(v for v in got if got[v] == r) for r in set(got.values())}


def test_golay_code_is_perfect():
    remainders, leaders = simhash.golay_tables()
    assert (leaders >= 0).all() and max(int(x).bit_count() for x in leaders) == 3
    x = np.arange(1 << 12, dtype=np.int64)
    words = x << 11 | remainders[x]
    assert min(int(w).bit_count() for w in words[1:]) == 7


def test_near_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_chains(spark):
    chain = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    assert {r.root for r in components(chain).collect()} == {0}
