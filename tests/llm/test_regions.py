"""The Jaccard join against brute force: whole table, chains around the threshold, large groups cut into cells."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from cuespark.llm import regions
from cuespark.llm.queries import QUERIES


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def naive(rows):
    """Counter of (doc_id, n_shingles, component_id) of the rows (doc_id, text)."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        common = Counter()
        for g in s:
            common.update(holders.setdefault(g, []))
            holders[g].append(i)
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def rows_of(df):
    return Counter(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op12_jaccard_regions"](spark, sf))
    assert got == naive(rows) and len({c for _, _, c in got}) < len(rows)


def make(seed):
    rng, rows = random.Random(seed), []
    for n in range(120):  # pairs on both sides of the threshold
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((20, 60, 150, 400)))]
        rows.append((2 * n, " ".join(words)))
        rows.append((2 * n + 1, " ".join(words[:len(words) - rng.randrange(len(words) // 4)])))
    base = [f"b{i}" for i in range(400)]
    for n in range(80):  # a chain in which only neighbours are linked, and a hot group around its start
        rows.append((1000 + n, " ".join(base[2 * n:2 * n + 100])))
        own = list(base[:100])
        for at in rng.sample(range(100), rng.randrange(4)):
            own[at] = f"x{rng.randrange(20)}"
        rows.append((2000 + n, " ".join(own)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(3000 + n, passage + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(100))) for n in range(80)]  # a common passage
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("run", "part"), [(1 << 15, 1 << 22), (5, 1 << 22), (1 << 15, 600), (20, 3000)])
def test_around_the_threshold(spark, run, part):
    """Frequent shingles over the limit of a task, regions cut into cells of cells, and into parts where pivots fail."""
    rows = make(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert rows_of(regions.jaccard_components(df, run=run, part=part)) == naive(rows)


def test_metric_join_within_a_task():
    rng = np.random.default_rng(3)
    for seed in range(40):
        sets = []
        for _ in range(6):
            base = rng.integers(0, 1 << 20, 80)
            for _ in range(rng.integers(1, 30)):
                own = base.copy()
                own[rng.integers(0, 80, rng.integers(0, 9))] = rng.integers(0, 1 << 20)
                base = own if seed % 2 else base  # drifts, or scatters around one
                sets.append(np.unique(own).astype(np.uint64))
        region = regions.Region(sets)
        region.join(np.arange(len(sets)), 4)
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, a in enumerate(sets):
            for j in range(i):
                common = len(np.intersect1d(a, sets[j]))
                if 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                    root[find(i)] = find(j)
        want = [find(i) for i in range(len(sets))]
        assert len(set(zip(want, region.label.tolist(), strict=True))) == len(set(want)) == len(set(region.label.tolist()))


def test_a_large_group_costs_its_size():
    """Near copies of one text: a few distances each, not one for every pair."""
    rng = np.random.default_rng(8)
    base, sets = rng.integers(0, 1 << 40, 200), []
    for _ in range(3000):
        own = base.copy()
        own[rng.integers(0, 200, 3)] = rng.integers(0, 1 << 40, 3)
        sets.append(np.unique(own).astype(np.uint64))
    region = regions.Region(sets)
    compared = []
    plain = region.common
    region.common = lambda one, others: (compared.append(len(others)), plain(one, others))[1]
    region.join(np.arange(len(sets)))
    assert len(set(region.label.tolist())) == 1 and sum(compared) < 20 * len(sets)


def test_signatures_are_bounds():
    rng = np.random.default_rng(2)
    for n in (50, 900, 1100, 5000, 20_000):
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.05, 0.08, 0.3, 1.0):
            other = np.unique(np.concatenate((base[int(len(base) * share):], rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64))))
            common = len(np.intersect1d(base, other))
            linked = 100 * common >= 85 * (len(base) + len(other) - common)
            signs = [np.frombuffer(regions.signature(x), np.uint8) for x in (base, other)]
            may = bool(regions._may_link(np.array([len(base)]), signs[0][None], np.array([len(other)]), signs[1][None])[0])
            if may and n > 1024 + 50:
                may = regions._may_link_long(len(base) + len(other), regions.long_signature(base), regions.long_signature(other))
            assert may or not linked
            assert share < 1 or not may  # sets with nothing in common are told apart at every size


def test_odd_rows(spark):
    rows = [(1, "one two three"), (2, "ONE  two\tthree"), (3, None), (4, ""), (None, " \n"), (5, "one two three four"), (None, "one two three"), (None, "lone text here"),
            (6, "word " * 100_000), (6, "word " * 100_000), (7, "word word word word"), (8, "É é É é"), (9, "é é é é")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id bigint, text string, fp int, region string, size string")
    assert rows_of(regions.jaccard_components(df)) == naive(rows)
    assert regions.jaccard_components(df.limit(0)).count() == 0
