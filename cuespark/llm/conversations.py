"""Conversation structure repair (11) by Four-Russians block tables.

A conversation is repaired by keeping (0), rerolling (2) or deleting (3) its rows and inserting empty ones (2), so that the
roles' initials spell ``(s?(ua)+)?``; blank and repeated rows must go, a truncated row that stays adds 1.  Each row is one
of nine symbols.  For every position the costs of finishing from each of the four states differ by a bounded amount, so
that, less their minimum, only a few cost vectors occur (``VECTORS``).  A table over all vectors and all blocks of four
symbols gives the vector in front of a block and what it adds; conversations are processed from their end, a block a
lookup.  The edits are then read off forward: each block is expanded backward from the vector behind it, and every step
takes the least letter that an optimum allows, which makes the audit the least of all cheapest ones.

Rows are sorted by range over all conversations.  A conversation within one task is repaired there.  One that crosses
tasks, or is long, is cut into chunks: a chunk becomes a map over vectors, then a map over states, which are chained in
order; only these small maps of a conversation meet in a task.  Its rows stream through a task once, for the hash of the
repaired text, which has to be computed in order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols: row's initial s, u, a or another, whole (0-3) or truncated (4-7); a row that must go; no row.
MUST_GO, NOTHING = 8, 9
SYMBOLS = 10
BLOCK = 4
#: Rows of a chunk, and of a conversation that a task repairs at once; bytes of the latter.
CHUNK = 4096
CHUNK_BYTES = 1 << 24

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The role that may follow in each state besides a system row at the start.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
WHITE = " \t\n\v\f\r"


# ---------------------------------------------------------------- tables
def _with_inserts(costs: list[int]) -> list[int]:
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT + out[NEXT_STATE[q]]) for q, c in enumerate(out)]
    return out


def _takes(symbol: int, state: int) -> int | None:
    """State after keeping a row, if it may be kept."""
    initial = "suax"[symbol % 4]
    if initial == "s":
        return AFTER_S if state == START else None
    return NEXT_STATE[state] if initial == NEXT_ROLE[state][0] else None


def _before(symbol: int, after: list[int]) -> list[int]:
    """Cost of finishing from each state in front of a row, from those behind it."""
    if symbol == NOTHING:
        return list(after)
    out = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if symbol != MUST_GO:
            extra = TRUNCATED if symbol >= 4 else 0
            ways.append(REROLE + extra + after[NEXT_STATE[state]])
            if (to := _takes(symbol, state)) is not None:
                ways.append(KEEP + extra + after[to])
        out.append(min(ways))
    return _with_inserts(out)


class Tables:
    """``step``: vector and cost in front of a symbol, by vector behind it; ``block``: the same for blocks of symbols;
    ``edits``: letters up to and with the row's own and the state after, by vector behind, symbol and state."""

    def __init__(self) -> None:
        high = 10**6
        end = _with_inserts([0, high, high, 0])
        vectors = [tuple(end)]
        number = {vectors[0]: 0}
        moves: list[list[tuple[int, int]]] = []
        for at in range(10**6):
            if at == len(vectors):
                break
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(symbol, list(vectors[at]))
                low = min(costs)
                least = tuple(c - low for c in costs)
                if least not in number:
                    number[least] = len(vectors)
                    vectors.append(least)
                row.append((number[least], low))
            moves.append(row)
        self.vectors = vectors
        step = np.array(moves)
        self.step_vector, self.step_cost = step[:, :, 0], step[:, :, 1]
        vector, cost = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int64)
        for _ in range(BLOCK):  # one more symbol in front
            cost = (cost[:, None, :] + self.step_cost[vector].swapaxes(1, 2)).reshape(len(vectors), -1)
            vector = self.step_vector[vector].swapaxes(1, 2).reshape(len(vectors), -1)
        self.block_vector, self.block_cost = vector, cost
        self.edits = [[[self._edit(v, symbol, state) for state in range(4)] for symbol in range(SYMBOLS)] for v in range(len(vectors))]
        self.tail = ["", "II", "I", ""]
        self.lists = self.block_vector.tolist(), self.block_cost.tolist(), self.step_vector.tolist()

    def _edit(self, behind: int, symbol: int, state: int) -> tuple[str, int]:
        if symbol == NOTHING:
            return "", state
        after, front = self.vectors[behind], _before(symbol, list(self.vectors[behind]))
        letters = ""
        while True:
            want = front[state]
            if DELETE + after[state] == want:
                return letters + "D", state
            if INSERT + front[NEXT_STATE[state]] == want:
                letters, state = letters + "I", NEXT_STATE[state]
                continue
            extra = TRUNCATED if symbol >= 4 else 0
            if (to := _takes(symbol, state)) is not None and KEEP + extra + after[to] == want:
                return letters + "K", to
            return letters + "R", NEXT_STATE[state]


_TABLES: Tables | None = None


def tables() -> Tables:
    """Built once in each process."""
    global _TABLES
    if _TABLES is None:
        _TABLES = Tables()
    return _TABLES


def blocks_of(symbols: list[int] | np.ndarray) -> np.ndarray:
    """Symbols as rows of blocks, the first filled up in front."""
    padded = np.concatenate((np.full(-len(symbols) % BLOCK, NOTHING), np.asarray(symbols, np.int64)))
    return padded.reshape(-1, BLOCK)


def codes_of(blocks: np.ndarray) -> list[int]:
    return (blocks @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()


def vector_map(symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each vector behind the symbols the one in front of them and the cost added."""
    t = tables()
    vector, cost = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    for code in reversed(codes_of(blocks_of(symbols))):
        cost += t.block_cost[vector, code]
        vector = t.block_vector[vector, code]
    return vector, cost


def edits_of(symbols: list[int], behind: int, states: tuple[int, ...]) -> tuple[list[list[str]], list[int], int, int]:
    """Edits of every row for each state in front, the states behind, and the vector in front and cost added."""
    t = tables()
    blocks = blocks_of(symbols)
    codes, vectors, cost = codes_of(blocks), [behind], 0
    by_block, costs, step = t.lists
    for code in reversed(codes):
        cost += costs[vectors[-1]][code]
        vectors.append(by_block[vectors[-1]][code])
    out, ends = [[] for _ in states], list(states)
    for block, right in zip(blocks.tolist(), vectors[-2::-1], strict=True):
        inner = [right]
        for symbol in reversed(block[1:]):  # the block expanded backward
            inner.append(step[inner[-1]][symbol])
        for symbol, v in zip(block, reversed(inner), strict=True):
            if symbol == NOTHING:
                continue
            for i, state in enumerate(ends):
                letters, ends[i] = t.edits[v][symbol][state]
                out[i].append(letters)
    return out, ends, vectors[-1], cost


# ---------------------------------------------------------------- one conversation
class Repair:
    """What is known of one conversation as its rows pass by in order."""

    def __init__(self) -> None:
        self.low = self.high = self.turn = self.role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.state, self.hash, self.first, self.audit, self.rows = START, hashlib.sha256(), True, [], 0

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def row(self, turn: int | None, role: str, text: str, symbol: int, letters: str) -> None:
        if turn is not None:
            self.turns += self.turn != turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if symbol == MUST_GO:
            if text.strip(WHITE):
                self.duplicate += 1
            else:
                self.blank += 1
        elif symbol >= 4:
            self.truncated += 1
        if self.rows:
            self.illegal += self.role[:1] + role[:1] not in ("su", "ua", "au")
        self.role, self.rows = role, self.rows + 1
        self.edit(letters, role, text)

    def edit(self, letters: str, role: str = "", text: str = "") -> None:
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                self._write(role, text)
                self.state = AFTER_S if role[:1] == "s" else NEXT_STATE[self.state]
            else:
                self._write(NEXT_ROLE[self.state], text if letter == "R" else "")
                self.state = NEXT_STATE[self.state]
        self.audit.append(letters)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
_RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def base_symbol(role: str, text: str) -> int:
    """Symbol of a row that no earlier row equals."""
    body = text.rstrip(WHITE)
    if not body:
        return MUST_GO
    return (("sua".find(role[0]) if role else -1) % 4) + 4 * (body[-1] not in ".!?")


def repair_whole(rows: list[tuple]) -> tuple:
    """Result for all rows (turn, role, text) of a conversation, in order."""
    out, seen, symbols = Repair(), set(), []
    for _, role, text in rows:
        symbol = base_symbol(role, text)
        if symbol != MUST_GO:
            if (role, text) in seen:
                symbol = MUST_GO
            seen.add((role, text))
        symbols.append(symbol)
    if rows:
        (letters,), (end,), vector, cost = edits_of(symbols, 0, (START,))
        for row, symbol, own in zip(rows, symbols, letters, strict=True):
            out.row(*row, symbol, own)
        out.edit(tables().tail[end])
        out.cost = cost + tables().vectors[vector][START]
    return out.result()


# ---------------------------------------------------------------- all conversations
def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: the rows after damage, those dropped as rows that are not present."""
    blank = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").when(F.col("fate") == 0, "").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), copies.alias("copy")).drop("copy")


def _by_conversation(names: list[str], finish: Callable, out_types: list[pa.DataType], out_names: list[str]):
    """mapInArrow function: ``finish`` is a generator function over (conv_id, row) runs: it gets an iterator of all rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).select(names).columns), strict=True)

        held: list[tuple] = []
        size = 0
        for row in finish(rows()):
            held.append(row)
            size += 1 + sum(len(x) for x in row if isinstance(x, str)) // 1024
            if size >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), out_types, strict=True)], out_names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), out_types, strict=True)], out_names)

    return each


def _first_pass(chunk: int, chunk_bytes: int):
    """Rows in order to results of conversations that end within the task, and to rows of all others.

    The first and the last conversation of a task may go on in its neighbours."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        none = (None,) * 8
        conv, held, size, spill, pos, first = None, [], 0, True, 0, True

        def spilled() -> Iterator[tuple]:
            nonlocal pos
            for turn, role, text, present, h1, h2 in held:
                yield (conv, False, *none, part, pos if present else -1, turn, role, text, present, base_symbol(role, text), h1, h2)
                pos += present
            held.clear()

        for conv_id, *row in rows:
            if first or conv_id != conv:
                if not first:
                    if spill:
                        yield from spilled()
                    else:
                        yield (conv, True, *repair_whole([(t, r, x) for t, r, x, present, _, _ in held if present]), *(None,) * 9)
                        held.clear()
                conv, size, spill, pos, first = conv_id, 0, first, 0, False
            held.append(row)
            size += len(row[2])
            if len(held) > chunk or size > chunk_bytes:
                spill, size = True, 0
                yield from spilled()
        if not first:
            yield from spilled()

    return run


def _vector_maps(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, part, chunk, symbols in rows:
        vector, cost = vector_map(symbols)
        yield conv, part, chunk, vector.tolist(), cost.tolist()


def _chain_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Chunks of conversations from the last to the first: the vector behind each, and the cost of all from it on."""
    now, vector, cost, any_row = None, 0, 0, False
    for conv, part, chunk, to, added in rows:
        last = not any_row or conv != now
        if last:
            now, vector, cost, any_row = conv, 0, 0, True
        behind = vector
        cost += added[vector]
        vector = to[vector]
        yield conv, part, chunk, behind, last, cost + tables().vectors[vector][START]


def _state_maps(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, part, chunk, symbols, behind in rows:
        yield conv, part, chunk, edits_of(symbols, behind, (0, 1, 2, 3))[1]


def _chain_on(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Chunks from the first to the last: the state in front of each."""
    now, state, any_row = None, START, False
    for conv, part, chunk, to in rows:
        first = not any_row or conv != now
        if first:
            now, state, any_row = conv, START, True
        yield conv, part, chunk, state, first
        state = to[state]


def _edit_lists(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, part, chunk, symbols, behind, last, cost, state, first in rows:
        (letters,), (end,), _, _ = edits_of(symbols, behind, (state,))
        if last:
            letters[-1] += tables().tail[end]
        yield conv, part, chunk, letters, symbols, cost if first else 0


def _finish(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows in order, each chunk's edits in front of its rows."""
    now, repair, edits = None, None, None
    for conv, turn, role, text, present, letters, symbols, cost in rows:
        if repair is None or conv != now:
            if repair is not None:
                yield now, *repair.result()
            now, repair = conv, Repair()
        if letters is not None:
            edits, repair.cost = zip(symbols, letters, strict=True), repair.cost + cost
        elif present:
            repair.row(turn, role, text, *next(edits))
    if repair is not None:
        yield now, *repair.result()


def _same(columns: list[str]) -> list:
    return [F.struct(F.col(c).alias("x")).alias(f"_{c}") for c in columns]


def _long(rows: DataFrame, kind: str, arrow_kind: pa.DataType, chunk: int) -> DataFrame:
    """Results of the conversations whose rows are given one by one."""
    present = rows.filter("present")
    again = present.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct("part", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(*_same(["conv_id"]), "role", "h1", "h2", "first")
    narrow = present.select("conv_id", *_same(["conv_id"]), "role", "h1", "h2", "part", "pos", "symbol").join(again, ["_conv_id", "role", "h1", "h2"], "left")
    symbol = F.when(F.col("first").isNotNull() & (F.col("first") != F.struct("part", "pos")), MUST_GO).otherwise(F.col("symbol"))
    place = ["conv_id", "part", "chunk"]
    cut = narrow.select("conv_id", "part", F.expr(f"pos div {chunk}").alias("chunk"), F.struct("pos", symbol.alias("symbol")).alias("row"))
    blocks = staged(cut.groupBy(*place).agg(F.array_sort(F.collect_list("row"))["symbol"].alias("symbols")), "conversation-blocks")

    def mapped(df: DataFrame, names: list[str], run: Callable, schema: str, types: list[pa.DataType]) -> DataFrame:
        out_names = [*place, *(f.split()[0] for f in schema.split(", "))]
        return df.select(*names).mapInArrow(_by_conversation(names, run, [arrow_kind, pa.int32(), pa.int64(), *types], out_names), f"conv_id {kind}, part int, chunk bigint, {schema}")

    ints = pa.list_(pa.int64())
    maps = mapped(blocks, [*place, "symbols"], _vector_maps, "to array<bigint>, added array<bigint>", [ints, ints])
    maps = maps.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
    back = staged(mapped(maps, [*place, "to", "added"], _chain_back, "behind bigint, last boolean, cost bigint", [pa.int64(), pa.bool_(), pa.int64()]), "vectors-behind")
    keys = ["_conv_id", "part", "chunk"]
    both = blocks.select("*", *_same(["conv_id"])).join(back.select(*_same(["conv_id"]), "part", "chunk", "behind", "last", "cost"), keys)
    states = mapped(both, [*place, "symbols", "behind"], _state_maps, "to array<bigint>", [ints])
    states = states.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    on = mapped(states, [*place, "to"], _chain_on, "state bigint, first boolean", [pa.int64(), pa.bool_()])
    all_three = both.join(on.select(*_same(["conv_id"]), "part", "chunk", "state", "first"), keys)
    edits = mapped(all_three, [*place, "symbols", "behind", "last", "cost", "state", "first"], _edit_lists, "letters array<string>, symbols array<bigint>, cost bigint", [pa.list_(pa.string()), ints, pa.int64()])
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("letters", "array<string>"), ("symbols", "array<bigint>"), ("cost", "bigint"))]
    stream = rows.select("conv_id", "part", "pos", F.lit(1).alias("kind"), "turn", "role", "text", "present", *nothing).unionByName(
        edits.select("conv_id", "part", (F.col("chunk") * chunk).alias("pos"), F.lit(0).alias("kind"), "letters", "symbols", "cost"), allowMissingColumns=True)
    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos", "kind")
    names = ["conv_id", "turn", "role", "text", "present", "letters", "symbols", "cost"]
    return ordered.select(*names).mapInArrow(_by_conversation(names, _finish, [arrow_kind, *_RESULT_TYPES], ["conv_id", *_RESULT_NAMES]), f"conv_id {kind}, {RESULT}")


def repair_conversations(rows: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Faults, cost, audit and hash of every conversation in ``rows`` (conv_id, turn, role, text, present).

    ``chunk`` and ``chunk_bytes`` bound what a task holds and never change a result.  Rows come by turn, those without one
    first, rows of one turn by role and then by a hash of their text.  A conversation without a present row has zeros, an
    empty audit and the hash of the empty string; so has none of an empty table.  Rows without a conv_id are one
    conversation.  An empty role has no initial, so it is in no legal pair and no row keeps it."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    hashed = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "present", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    order = ["conv_id", "turn", "role", "h1", "h2"]
    names = ["conv_id", "turn", "role", "text", "present", "h1", "h2"]
    out = {"done": pa.bool_(), **dict(zip(_RESULT_NAMES, _RESULT_TYPES, strict=True)), "part": pa.int32(), "pos": pa.int64(), "turn": pa.int64(), "role": pa.string(),
           "text": pa.string(), "present": pa.bool_(), "symbol": pa.int64(), "h1": pa.int64(), "h2": pa.int64()}
    run = _by_conversation(names, _first_pass(chunk, chunk_bytes), [arrow_kind, *out.values()], ["conv_id", *out])
    ordered = hashed.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
    schema = f"conv_id {kind}, done boolean, {RESULT}, part int, pos bigint, turn bigint, role string, text string, present boolean, symbol bigint, h1 bigint, h2 bigint"
    first = staged(ordered.mapInArrow(run, schema), "conversations")
    own = first.filter("done").select("conv_id", *_RESULT_NAMES)
    rest = first.filter("not done").select("conv_id", "part", "pos", "turn", "role", "text", "present", "symbol", "h1", "h2")
    return own.unionByName(_long(rest, kind, arrow_kind, chunk))


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """The contract's table: conversations as damaged by the checksum of ``conv_id:turn``, then repaired.

    Null texts, roles and parts of the key count as one space; other columns play no part; very long texts pass whole."""
    return repair_conversations(damaged(conversations))
