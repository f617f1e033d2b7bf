"""Near duplicates by 5-word shingles against brute force on Jaccard similarity."""

from __future__ import annotations

import random
import re
from fractions import Fraction

from cuespark.llm import similar

SCHEMA = "doc_id bigint, text string, lang string, root string, size string, fp string"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def naive(rows):
    """Positions of the rows (doc_id, text), in the order of ids with null last, that stay."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j < i and 5 * min(len(s), len(sets[j])) >= 4 * max(len(s), len(sets[j]))}:
            if Fraction(len(s & sets[j]), len(s | sets[j])) >= Fraction(4, 5):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [rows[i] for i in sorted(set(root))]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = similar.drop_similar(docs).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in naive(rows)] and len(got) < len(rows)
    assert got[0].__fields__ == docs.columns


def test_around_the_threshold(spark):
    rng, rows = random.Random(5), []
    for n in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 150, 400)))]
        rows.append((2 * n, " ".join(words)))
        cut = rng.randrange(len(words) // 3)  # off the end: similarity falls shingle by shingle
        rows.append((2 * n + 1, " ".join(words[:len(words) - cut])))
    base = [f"b{i}" for i in range(120)]
    for n in range(60):  # a chain in which only neighbours are similar, and copies of its start
        rows.append((1000 + n, " ".join(base[n:n + 60])))
        rows.append((2000 + n, " ".join([*base[:59], f"x{n}"])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [d for d, _ in naive(rows)]
    assert 150 < len(want) < 300
    assert sorted(r.doc_id for r in similar.drop_similar(docs).collect()) == want
    sketches = similar.sketch_rows(docs, "doc_id", "text")
    for block, part in ((3, 500), (1 << 15, 100)):  # runs that are over the limit, blocks in many parts
        kept = similar.similar_classes(docs, sketches, "doc_id", "text", block, part).groupBy("root").agg({"first": "min"})
        assert sorted(r[1].row_id for r in kept.collect()) == want


def test_odd_rows(spark):
    line = "one two three four five six seven eight nine ten eleven twelve "
    rows = [(1, line, "a"), (1, "quite another text under the same id and no other", "b"), (2, line.upper(), "c"), (3, "quite another text  under the same id and no other", "d"),
            (None, line + "more", "e"), (None, "only here", "f"), (None, "only  HERE", "g"), (4, None, "h"), (5, "", "i"), (6, " \n", "j"), (7, "a b", "k"), (7, "a b", "k"), (8, "word " * 200_000, "l")]
    docs = spark.createDataFrame([(*r, *[""] * 3) for r in rows], SCHEMA)
    got = similar.drop_similar(docs)
    assert got.columns == docs.columns
    got = sorted(r.lang for r in got.collect())
    assert got in (["a", "b", x, "h", "k", "l"] for x in "fg")
    assert similar.drop_similar(docs.limit(0)).count() == 0
