"""The stages of the pipeline one after the other on odd rows, each against what it was given, and on an empty table."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from cuespark.llm import bpe
from cuespark.llm.common import staged
from test_dedup import hex_of
from test_similar import naive

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id string, copies int, __row string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "the river runs past old mills and slow fields where small boats wait for rain under grey skies all day".split()


def prose(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i + i // 3) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty and blank texts, null ids, sources and languages, whole rows that repeat, ties, and a very long text."""
    rows = [(i, prose(i, 60 + i), "en", "web" if i % 3 else "books", 300) for i in range(1, 25)]
    rows += [(30, None, "en", "web", 0), (31, "", "en", "web", 0), (32, " \n\t", None, None, 3), (33, None, None, None, None)]
    rows += [(None, prose(50, 70), "en", "web", 1), (None, None, None, None, None), (3, prose(3, 63), "en", "web", 300)]
    rows += [(2, prose(2, 62), "en", "web", 300)] * 3 + [(40, prose(5, 65), "de", None, 1), (41, prose(6, 66).replace(" ", "\n"), "de", "x", 1)]
    rows += [(42, prose(9, 40_000), "en", "web", 1), (43, "x" * 200_000, "en", "books", 1), (44, "one", "en", "books", 3), (45, "One", "en", "books", 3)]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(*r, "r", 7, None) for r in rows], DOCS).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(i % 4 > 0), 0) for i in range(1, 25)] + [(30, 0, 0), (44, None, None), (None, 1, 0), (99, 1, 0), (2, 1, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, odd):
    """What each stage was given, and what the last one gave."""
    import corpus_pipeline

    out = [spark.read.parquet(f"{odd}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], odd), name.replace(" ", "-")))
    return [(t.columns, [tuple(r) for r in t.collect()]) for t in out]


def test_columns_stay(tables):
    assert all(columns == tables[0][0] for columns, _ in tables[:-1])


def test_quality_keeps_rows_as_they_are(tables):
    given, kept = Counter(tables[0][1]), Counter(tables[1][1])
    assert kept and all(given[r] == n for r, n in kept.items())  # a row stays with its repeats or goes with them


def test_exact_keeps_one_row_of_each_text(tables):
    given, kept = tables[1][1], tables[2][1]
    assert sorted(hex_of(r[1]) for r in kept) == sorted({hex_of(r[1]) for r in given}) and not Counter(kept) - Counter(given)
    for r in kept:
        ids = [g[0] for g in given if hex_of(g[1]) == hex_of(r[1])]
        assert r[0] == min((i for i in ids if i is not None), default=None)


def test_near_keeps_one_row_of_each_group(tables):
    given, kept = tables[2][1], tables[3][1]
    assert not Counter(kept) - Counter(given)
    numbered = [(i if r[0] is None else r[0], r[1]) for i, r in enumerate(given, 10_000)]  # rows without an id come last
    assert len(kept) == len(naive(numbered))


def test_mixing_drops_no_row(tables):
    given, used = Counter(tables[3][1]), Counter(tables[4][1])
    assert set(given) == set(used) and all(given[r] <= n <= 2 * given[r] for r, n in used.items())


def test_every_row_is_encoded(tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    got = [dict(zip(tables[5][0], r)) for r in tables[5][1]]
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in tables[4][1])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    for r in got:
        text = library.decode(r["ids"], skip_special_tokens=False)
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
