"""Language identification on held-out documents; rule statistics against brute force, rules on planted labels."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespark.llm import langid, rules

SCHEMA = "doc_id bigint, text string, lang string, stats string, bad string, score string"


def test_codewords_are_far_apart():
    for n in (1, 2, 3, 4, 7, 8, 20):
        code = langid.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert all(g >= 4 for g in gaps) and (n < 2 or (np.abs(code.sum(axis=0)) < n).all())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    shuffled = docs.withColumns({"lang": F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("s")})
    again = langid.learn_and_identify(shuffled).toPandas().set_index("doc_id").lang_pred
    assert (again.loc[got.doc_id].values == got.lang_pred.values).all()


def test_langid_odd_rows(spark):
    rows = [(1, "the house and the tree", "en", "", "", ""), (2, "das Haus und der Baum", "de", None, None, None), (3, None, "en", "", "", ""), (4, "123 !?", "de", "", "", ""),
            (5, "", None, "", "", ""), (None, "the tree", "en", "", "", ""), (6, "der Baum", None, "", "", ""), (7, "the and " * 200_000, None, "", "", ""), (6, "der Baum", None, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en", 6: "de", 7: "en"}
    assert got[3].score == 0.0 and got[3].ambiguous and got[None].held_out is False
    assert {r.lang_pred for r in langid.learn_and_identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = docs.withColumn("lang", F.lit("en"))
    assert {r.lang_pred for r in langid.identify(one, langid.train(one)).collect()} == {"en", "und"}
    assert langid.learn_and_identify(docs.limit(0)).count() == 0


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, sf_dir):
    rng = random.Random(4)
    parts = ["a", "b", "é", "😀", "#", "&x", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\xa0", "a b c", "$%", "\r\n"]
    texts = [None, "", " ", "\n", "a b c a b c a b c", "x " * 30_000] + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in rules.text_statistics(docs).collect():
        assert tuple(r.stats) == naive(texts[r.doc_id]), texts[r.doc_id]


def stats_rows(spark, n, bad):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        words = rng.randint(60, 500)
        row = (words, words * rng.randint(4, 7), rng.choice([0, 0, 0, words // 3]), 0, rng.choice([0, words // 4]))
        rows.append((i, row, bad(*row)))
    return spark.createDataFrame(rows, "doc_id bigint, stats struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint>, bad boolean")


def test_rules_find_conjunctions(spark):
    table = stats_rows(spark, 3000, lambda w, c, s, d, r: bool(s and r) or c == 4 * w)
    found = rules.learn_rules(table)
    assert 2 <= len(found.rules) <= 6
    got = table.select("bad", found.rule_number(rules.ratios()).isNotNull().alias("hit")).toPandas()
    assert (got.bad == got.hit).mean() > 0.99
    assert any(len(r) == 2 and {c.statistic for c in r} == {"symbol_share", "repeat_share"} for r in found.rules)
    noise = random.Random(1)
    assert not rules.learn_rules(stats_rows(spark, 600, lambda *a: noise.random() < 0.2)).rules
    assert not rules.learn_rules(table.limit(0)).rules and not rules.learn_rules(table.withColumn("bad", F.lit(False))).rules


def test_rule_rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, None, "a", "b", None), (2, None, "a", "b", None, "c"), (2, None, "a", "b", None, "c"), (None, good, "", "", "", ""), (3, "x " * 100, "", "", "", ""), (4, good + " #" * 60, "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (4, 0, 0), (4, 1, 0), (99, 0, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = rules.learn_and_judge(docs, labels).collect()
    assert len(got) == 6
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed) for r in got) == [(0, 60, False), (1, 60, False), (2, 0, True), (2, 0, True), (3, 100, True), (4, 120, False)]
    assert all(r.kept is not None and not (r.base_failed and r.kept) for r in got)
    assert rules.learn_and_judge(docs.limit(0), labels).count() == 0
    plan = rules.text_statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_rules_on_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.learn_and_judge(docs, labels).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95
