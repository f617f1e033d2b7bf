"""Mixing against its definition; the quality classifier on labels and its shrinking against the formula."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespark.llm import mixing, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, tokens string, position string, site string, kept string"


def table(spark, sizes):
    rng = random.Random(2)
    rows = []
    for source, n in sizes.items():
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(1, 9)), "en", source, "", "", "", "") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def entropy(weights):
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights) / math.log(len(weights))


@pytest.mark.parametrize(("target", "limit"), [(0.97, 1e9), (0.97, 1.5), (0.5, 2.0), (1.0, 50.0)])
def test_temperature(spark, target, limit):
    docs = table(spark, {"a": 400, "b": 60, "c": 30})
    sources = mixing.source_totals(mixing.token_rows(docs, "doc_id", "text", "source"))
    got = mixing.find_temperature(sources, target, limit)
    tokens = {r.source["name"]: r.tokens for r in sources.collect()}
    weights = [t ** got.exponent for t in tokens.values()]
    assert got.entropy == pytest.approx(entropy(weights), abs=1e-9)
    most = max(tokens.values())
    assert got.repeats == pytest.approx((most / min(tokens.values())) ** (1 - got.exponent), rel=1e-9) and got.repeats <= limit + 1e-6
    by_target = 1.0 if entropy(list(tokens.values())) >= target else next(t / 1e4 for t in range(10_000, -1, -1) if entropy([x ** (t / 1e4) for x in tokens.values()]) >= target - 1e-9)
    by_limit = max(0.0, 1 - math.log(limit) / math.log(most / min(tokens.values())))
    assert got.exponent == pytest.approx(max(by_target, by_limit), abs=2e-4)


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_dealing(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "SLAB_BLOCKS", 3)
    docs = table(spark, {"a": 400, "b": 60, None: 30})
    uses = mixing.mix(docs, target_entropy=0.9, max_repeats=3.0, block_tokens=block).collect()
    tokens = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    total, used, times = Counter(), Counter(), defaultdict(Counter)
    for r in docs.collect():
        total[r.source] += tokens[r.doc_id]
    for u in uses:
        used[u.source] += u.tokens
        times[u.source][u.doc_id] += 1
        assert u.tokens == tokens[u.doc_id]
    sources = mixing.source_totals(mixing.token_rows(docs, "doc_id", "text", "source"))
    found = mixing.find_temperature(sources, 0.9, 3.0)
    z = sum(t ** found.exponent for t in total.values())
    for s in total:
        quota = total[s] ** found.exponent / z * found.budget
        assert quota - 1e-6 <= used[s] < quota + 9 + 1e-6  # the last document may pass the quota
        assert min(times[s].values()) >= 1 and max(times[s].values()) - min(times[s].values()) <= 1
        spans = sorted((u.position, u.tokens) for u in uses if u.source == s)
        at = 0
        for position, n in spans:
            assert position == pytest.approx(at / quota, abs=1e-9)
            at += n
    if block == 40:
        assert len({(u.source, u.block) for u in uses}) > 20
    assert sorted(map(tuple, uses), key=str) == sorted(map(tuple, mixing.mix(docs, target_entropy=0.9, max_repeats=3.0, block_tokens=block).collect()), key=str)
    copies = mixing.mixed_documents(docs, target_entropy=0.9, max_repeats=3.0, block_tokens=block)
    assert copies.columns == docs.columns and Counter(r.doc_id for r in copies.collect()) == Counter(u.doc_id for u in uses)


def test_budget_and_odd_rows(spark):
    docs = table(spark, {"a": 300, "b": 100})
    assert 0 < sum(u.tokens for u in mixing.mix(docs, budget=500.0).collect()) - 500 < 20
    rows = [(1, None, None, None, "", "", "", ""), (None, "a b", None, "x", "", "", "", ""), (2, "a", None, "y", "", "", "", ""), (2, "a", None, "y", "", "", "", ""), (3, "w " * 100_000, None, "z", "", "", "", "")]
    odd = spark.createDataFrame(rows, SCHEMA)
    assert Counter(u.doc_id for u in mixing.mix(odd, max_repeats=1.0).collect()) == Counter({1: 1, None: 1, 2: 2, 3: 1})
    assert mixing.mixed_documents(odd, max_repeats=1.0).count() == 5
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- quality
def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97
    half = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    unseen = quality.classify_quality(docs, half).join(labels.join(half, "doc_id", "left_anti"), "doc_id").toPandas()
    assert len(unseen) > 1000 and (unseen.kept == (unseen.quality == 1)).mean() > 0.97


def test_shrinking(spark):
    rng = random.Random(1)
    rows = [(("h%d" % h, "p%d" % p), float(rng.random() < 0.2 + 0.06 * h)) for h in range(12) for p in range(3) for _ in range(1 if h == 11 and p == 2 else 40)]
    judged = spark.createDataFrame(rows, "site struct<host: string, path: string>, good double")
    got = {(r.site.host, r.site.path): r for r in quality.site_rates(judged, 0.5).collect()}
    raw, hosts = defaultdict(list), defaultdict(list)
    for (h, p), g in rows:
        raw[h, p].append(g)
        hosts[h].append(g)
    overall = (sum(g for _, g in rows) + 0.5) / (len(rows) + 1)
    n, rate = np.array([len(v) for v in hosts.values()]), np.array([np.mean(v) for v in hosts.values()])
    chance = overall * (1 - overall)
    beyond = ((n * (rate - overall) ** 2).sum() - (len(n) - 1) * chance) / (n.sum() - (n**2).sum() / n.sum())
    k = float(np.clip(chance / beyond - 1, quality.WEAKEST, quality.STRONGEST))
    for (h, _), r in got.items():
        assert r.host_rate == pytest.approx((sum(hosts[h]) + k * overall) / (len(hosts[h]) + k))
    thin = got["h11", "p2"]
    assert abs(thin.path_rate - thin.host_rate) < abs(raw["h11", "p2"][0] - thin.host_rate) / 2  # one document moves its path little


def test_quality_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good + f" x{i}", "en", "s", "", "", "", "") for i in range(40)] + [(100 + i, "| # | # " * 30, "en", "s", "", "", "", "") for i in range(40)]
    rows += [(200, None, None, None, None, None, None, None), (201, "", "en", "s", "", "", "", ""), (None, good, "en", None, "", "", "", ""), (1, good + " x1", "en", "s", "", "", "", ""), (202, good * 3000, "en", "s", "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(100 + i, 0, 0) for i in range(0, 40, 2)] + [(7, None, 0), (None, 0, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.classify_quality(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id < 100) for r in got if r.doc_id is None or r.doc_id < 200)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect())[1] == 2  # a repeated row stays repeated
    assert quality.classify_quality(docs, labels.limit(0)).filter("kept").count() == len(rows)
    assert quality.classify_quality(docs.limit(0), labels).count() == 0


def test_repeated_rows_are_judged_and_kept_one_by_one(spark):
    """No row goes because another equals it in id and text, nor because of repeats elsewhere in the table."""
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "a b", "fr", "s"), (2, "c d", "en", "t"), (None, "e", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert Counter(map(tuple, quality.keep_good(docs, labels).collect())) == Counter(rows)
    uses = Counter(u.source for u in mixing.mix(docs, max_repeats=2.0).collect())
    mixed = Counter(map(tuple, mixing.mixed_documents(docs, max_repeats=2.0).collect()))
    assert set(mixed) == set(rows) and sum(mixed.values()) == sum(uses.values())
    for source, n in uses.items():
        assert sum(k for r, k in mixed.items() if r[3] == source) == n


def test_fitting_rows_are_those_of_a_plain_sort(spark):
    rows = spark.range(30_000).select(F.col("id").alias("row_id"), F.array(F.lit(1.0)).alias("x"))
    known = spark.range(0, 30_000, 2).select(F.col("id").alias("row_id"), F.lit(1).alias("quality"))
    want = [r.row_id for r in known.orderBy(F.xxhash64("row_id"), "row_id").limit(1000).collect()]
    assert [r.row_id for r in quality.fitting_rows(rows, known, 1000)] == want
    assert len(quality.fitting_rows(rows, known, 20_000)) == 15_000


def test_rows_without_words_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("s").alias("source"))
    uses = mixing.mix(docs).collect()
    assert sorted(u.doc_id for u in uses) == list(range(600)) and len({u.block for u in uses}) == 12


def test_equal_sources_and_shares(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(40)], "doc_id bigint, text string, source string")
    assert Counter(u.doc_id for u in mixing.mix(docs).collect()) == Counter(range(40))
