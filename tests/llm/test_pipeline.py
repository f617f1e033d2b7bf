"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from cuespark.llm import bpe, mixing
from cuespark.llm.common import staged
from test_dedup import hex_of
from test_similar import naive

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns(kept):
    assert all(d.schema == kept[0].schema for d in kept[:-1])


def test_quality_stage(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stays = {r.doc_id for r in kept[1].collect()}
    right = sum((d in stays) == (q == 1) for d, q in labels.items())
    assert right / len(labels) > 0.97 and len(stays) == kept[1].count()


def test_exact_stage(kept):
    first = {}
    for r in sorted(kept[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(hex_of(r.text), r)
    assert sorted(map(tuple, first.values())) == sorted(map(tuple, kept[2].collect()))


def test_near_stage(kept):
    """Of each group of documents that a similarity of 0.8 or more of 5-word shingles links, the first stays."""
    rows = kept[2].collect()
    want = naive([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in kept[3].collect()) == [d for d, _ in want] and len(want) < len(rows)
    assert set(map(tuple, kept[3].collect())) <= set(map(tuple, rows))


def test_mixing_stage(kept):
    before = {r.doc_id: r for r in kept[3].collect()}
    uses = Counter(r.doc_id for r in kept[4].collect())
    assert set(uses) == set(before) and max(uses.values()) <= mixing.MAX_REPEATS
    assert set(map(tuple, kept[4].collect())) == set(map(tuple, before.values()))
    tokens, used = defaultdict(int), defaultdict(int)
    for d, r in before.items():
        tokens[r.source] += len(r.text.split())
        used[r.source] += uses[d] * len(r.text.split())
    order = sorted(tokens, key=tokens.get)
    shares = [used[s] / tokens[s] for s in order]
    assert shares[-1] == 1.0 and shares[0] == max(shares)


def test_encoding_stage(kept):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    got = kept[5].collect()
    assert len(got) == kept[4].count()
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_is_the_stages(spark, kept):
    import corpus_pipeline

    run = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.ids_sha256) for r in run.collect()) == Counter((r.doc_id, r.ids_sha256) for r in kept[5].collect())
