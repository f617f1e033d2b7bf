"""Line templates against a plain reading of the rules."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

from cuespark.llm import templates

SCHEMA = "doc_id bigint, text string, lang string, line string, leaf string, tokens string, drops string"


def hashed(words):
    return xxhash.xxh64(words.encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(words.encode(), seed=42).intdigest() >> 63)


def naive(rows):
    """rows: (doc_id, text) with distinct ids; the text that stays of each."""
    leaves, uses = defaultdict(set), []
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            tokens = tuple("<*>" if re.search("[0-9@]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
            if tokens:
                leaf = (len(tokens), tokens[:4])
                leaves[leaf].add(tokens)
                uses.append((doc, no, leaf, tokens))
    docs_of, uses_of = defaultdict(set), defaultdict(list)
    for use in uses:
        docs_of[use[2]].add(use[0])
        uses_of[use[2]].append(use)
    name = {}
    for leaf, lines in leaves.items():
        modal = [max(Counter(x[i] for x in lines).items(), key=lambda kv: (kv[1], kv[0].encode()))[0] for i in range(leaf[0])]
        alike = lambda x, y: sum(a == b for a, b in zip(x, y, strict=True)) >= 0.6 * len(x)
        near = [x for x in lines if len(lines) > 1 and len(docs_of[leaf]) > 1 and alike(x, modal)]
        first = {x: min(doc for doc, _, _, y in uses_of[leaf] if x == y) for x in near}
        stays = min(near, key=lambda x: (first[x], hashed(" ".join(x))), default=None)
        for x in lines:
            name[leaf, x] = ("leaf", leaf) if x in first and alike(x, stays) else ("line", x)
    seen = defaultdict(set)
    for doc, _, leaf, x in uses:
        seen[name[leaf, x]].add(doc)
    drop = {(doc, no) for doc, no, leaf, x in uses if len(seen[name[leaf, x]]) > 1 and doc != min(seen[name[leaf, x]])}
    return {doc: "\n".join(x for no, x in enumerate((text or "").split("\n")) if (doc, no) not in drop) for doc, text in rows}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = naive([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in templates.dedup_lines(docs).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert sum(r.n_dropped for r in got.values()) > 100
    for r in templates.line_decisions(docs).collect():
        assert (r.n_lines, r.n_dropped) == (got[r.doc_id].n_lines, got[r.doc_id].n_dropped) and len(set(r.dropped)) == r.n_dropped
    assert all(r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got.values())


def test_fields_and_first_document(spark):
    rows = [(2, "Order 17 shipped to anna@x.org today\nown line two"), (1, "Order 9 shipped to bob@y.com today\n\nown line"), (3, "a b c d e f g h i j\nrest"), (4, "a b c d e X g h i j\nmore"), (5, "a b c d P Q R S T j")]
    got = {r.doc_id: r.text for r in templates.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[1][1], 2: "own line two", 3: rows[2][1], 4: "more", 5: rows[4][1]} == naive(rows)


def test_lines_that_share_only_their_front_stay(spark):
    """Two sentences that meet a mixed template in different places are not one line."""
    rows = [(1, "The old town of zulu apple yankee ant"), (2, "The old town of bravo tango charlie sierra"), (3, "The old town of bravo tango charlie hotel")]
    got = {r.doc_id: r.text for r in templates.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and got == naive(rows)


def test_odd_rows(spark):
    rows = [(1, "x y z\nq", "", "", "", "", ""), (1, "x y z\nq", "", "", "", "", ""), (None, "x y z\nmine", None, None, None, None, None), (2, None, "", "", "", "", ""), (3, "", "", "", "", "", ""),
            (4, "x y z", "", "", "", "", ""), (5, "same\nsame\nsame", "", "", "", "", ""), (6, "long " * 100_000 + "\nx  y\tz", "", "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = templates.dedup_lines(docs).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in got) == [(0, 2, 1), (1, 2, 0), (1, 2, 0), (2, 1, 0), (3, 1, 0), (4, 1, 1), (5, 3, 0), (6, 2, 1)]
    assert sorted((r.doc_id or 0, r.n_lines, r.dropped) for r in templates.line_decisions(docs).collect()) == [
        (0, 2, [0]), (1, 2, []), (1, 2, []), (2, 1, []), (3, 1, []), (4, 1, [0]), (5, 3, []), (6, 2, [1])]
    assert templates.dedup_lines(docs.limit(0)).count() == 0 and templates.line_decisions(docs.limit(0)).count() == 0
