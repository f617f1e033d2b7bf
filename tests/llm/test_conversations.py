"""Conversation repair against a plain search over edits, within tasks and over chunks."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from cuespark.llm import conversations as c
from cuespark.llm.queries import QUERIES

SPACE = r"\x20\x09-\x0D"


def naive(rows):
    """Result for the rows (turn, role, text) in order, by uniform-cost search with audits as tie-breaks."""
    faults, seen, kinds = [0, 0, 0], set(), []
    for _, role, text in rows:
        kind = None
        if not re.search(f"[^{SPACE}]", text):
            kind = 0
        elif (role, text) in seen:
            kind = 1
        elif re.findall(f"[^{SPACE}]", text)[-1] not in ".!?":
            kind = 2
        seen.add((role, text))
        kinds.append(kind)
        if kind is not None:
            faults[kind] += 1
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    turns = {t for t, _, _ in rows if t is not None}
    best, queue = {}, [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, state, text = heapq.heappop(queue)
        if (at, state) in best and best[at, state] <= (cost, audit):
            continue
        best[at, state] = cost, audit
        if at == len(rows) and state in ("", "a"):
            return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(text).encode()).hexdigest())
        role = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 2, audit + "I", at, role[0], (*text, f"{role}:")))
        if at < len(rows):
            _, own, words = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, text))
            if kinds[at] not in (0, 1):
                extra = kinds[at] == 2
                if own[:1] == role[0] or own[:1] == "s" and state == "":
                    heapq.heappush(queue, (cost + extra, audit + "K", at + 1, own[0], (*text, f"{own}:{words}")))
                heapq.heappush(queue, (cost + 2 + extra, audit + "R", at + 1, role[0], (*text, f"{role}:{words}")))
    raise AssertionError


def spoil(rows):
    """{conv_id: rows after damage, in order} of (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            own += [row] * (2 if fate == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for k, v in out.items()}


def random_rows(rng, n):
    texts = ["Yes.", "No!", "So then", "One thing? ", " \t", "", "a.\v", "More words here.", "b"] + [f"Text {i}." for i in range(40)]
    return [(rng.choice((i, i, i + 1)), rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "unit")), rng.choice(texts)) for i in range(n)]


def test_few_vectors_and_tables():
    t = c.tables()
    assert len(t.vectors) < 100 and max(map(max, t.vectors)) <= 8
    rng = random.Random(1)
    for n in range(200):
        symbols = [rng.randrange(9) for _ in range(n % 23)]
        if symbols:
            vector, cost = c.vector_map(symbols)
            for behind in range(len(t.vectors)):
                v, total = behind, 0
                for s in reversed(symbols):
                    total += t.step_cost[v, s]
                    v = t.step_vector[v, s]
                assert (vector[behind], cost[behind]) == (v, total)


def test_one_conversation():
    rng = random.Random(2)
    for _ in range(600):
        rows = sorted(random_rows(rng, rng.randrange(12)), key=lambda r: r[0])
        assert c.repair_whole(rows) == naive(rows), rows


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_tables"](spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {k: naive(v) for k, v in spoil(rows).items()}
    assert got.count() == len(spoil(rows))


@pytest.mark.parametrize("chunk", [1, 3, 8, 4096])
def test_chunks_and_odd_rows(spark, chunk):
    rng, rows = random.Random(chunk), []
    for conv in range(30):
        for turn, (_, role, text) in enumerate(random_rows(rng, rng.randrange(1, 9))):
            rows.append((conv, turn * rng.choice((1, 1, 2)) + 100 * turn, role, text))
    rows += [(99, i, "user" if i % 3 else "assistant", f"Line {i % 150}.") for i in range(200)]  # a hot conversation
    rows += [(None, 1, "user", "Who?"), (None, 2, None, "Me."), (40, None, "user", None), (41, 3, "assistant", "word " * 50_000), (42, 5, None, None)]
    lone = next(i for i in range(1000) if zlib.crc32(f"{5000 + i}:1".encode()) % 20 == 0)
    rows.append((5000 + lone, 1, "user", "Dropped."))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, pos int").repartition(3)
    got = c.repair_conversations(c.damaged(df), chunk=chunk).collect()
    want = {k: naive(v) for k, v in spoil(rows).items()}
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want  # turns of a conversation differ, so their order is fixed
    assert want[5000 + lone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert c.audit_damaged(df.limit(0)).count() == 0


def test_equal_rows(spark):
    """Rows repeated whole are duplicates of the first."""
    rows = [(1, 1, "user", "Same."), (1, 1, "user", "Same."), (1, 1, "user", "Same."), (1, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("present", c.F.lit(True))
    (got,) = c.repair_conversations(df).collect()
    assert tuple(got[1:]) == naive([r[1:] for r in rows]) and got.duplicate == 2
