"""Quality rules (10): learned decision lists over text statistics, with DataFrame and SQL functions only.

Sequential covering: a rule is a conjunction of thresholds on statistics.  It is grown on two thirds of the labelled
documents, always by the condition with the best gain among all thresholds of all statistics, and then pruned on the last
third by dropping final conditions while that does not lower its worth.  Documents it covers are set aside and the next
rule is grown on the rest, until no rule is precise enough.  Each rule ends as a conjunction of column comparisons, and the
list as one ordered CASE expression.

Each growing step is one grouped count over (statistic, bin, label), so the driver sees statistics times bins numbers
whatever the table's size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from .common import staged

SYMBOLS = "#*$%&|<>"
#: The base rule of the contract.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: What the rules may look at: ratios, so that they mean the same for texts of any length.
STATISTICS = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "words")
BINS, MAX_RULES, MAX_CONDITIONS = 40, 12, 4
#: A rule must cover so many held-back documents of which so large a share is bad.
LEAST_COVERED, LEAST_PRECISION = 5, 0.9


def text_statistics(docs: DataFrame, text_col: str = "text", into: str = "stats") -> DataFrame:
    """Adds ``into``: a struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text counts as empty.

    Windows of three words are compared by sorting: each window is its 64-bit hash with the lowest bits replaced by its
    position, as many bits as positions need.  Neighbours in the sorted list with equal upper bits whose words are equal
    too are repeats, and the words under repeated windows are counted in one pass over their positions.  So the time is
    n log n in the length of a text, and nothing leaves its row."""
    text, keep = F.coalesce(F.col(text_col), F.lit("")), docs.columns
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     ")) != "")
    d = docs.select(F.struct("*").alias("__row"), text.alias("__text"), flat.alias("__flat"), lines.alias("__lines"))
    d = once(d, {"__words": F.array_remove(F.split("__flat", " "), "")})
    d = d.select(
        "__row", "__words", F.size("__words").alias("__n"), F.length(F.bin(F.size("__words"))).alias("__bits"),
        F.length(F.replace("__flat", F.lit(" "), F.lit(""))).alias("__chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).alias("__symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("__dups"))
    d = once(d, {"__sorted": F.expr(
        "sort_array(IF(__n < 3, CAST(array() AS array<bigint>), transform(sequence(0, greatest(__n - 3, 0)), "
        "i -> shiftleft(shiftright(xxhash64(__words[i], __words[i + 1], __words[i + 2]), __bits), __bits) | i)))")})
    same = ("(shiftright(x ^ __sorted[{0}], __bits) = 0L"
            " AND __words[CAST(x & (shiftleft(1L, __bits) - 1) AS int)] = __words[CAST(__sorted[{0}] & (shiftleft(1L, __bits) - 1) AS int)]"
            " AND __words[CAST(x & (shiftleft(1L, __bits) - 1) AS int) + 1] = __words[CAST(__sorted[{0}] & (shiftleft(1L, __bits) - 1) AS int) + 1]"
            " AND __words[CAST(x & (shiftleft(1L, __bits) - 1) AS int) + 2] = __words[CAST(__sorted[{0}] & (shiftleft(1L, __bits) - 1) AS int) + 2])")
    d = once(d, {"__places": F.expr(
        f"sort_array(transform(filter(__sorted, (x, i) -> (i > 0 AND {same.format('i - 1')}) OR (i < __n - 3 AND {same.format('i + 1')})),"
        " x -> CAST(x & (shiftleft(1L, __bits) - 1) AS int)))")})
    repeated = F.expr(
        "aggregate(__places, named_struct('stop', 0, 'total', 0),"
        " (a, p) -> named_struct('stop', p + 3, 'total', a.total + p + 3 - greatest(a.stop, p)), a -> a.total)")
    long = [c.cast("bigint").alias(n) for c, n in (
        (F.col("__n"), "n_words"), (F.col("__chars"), "word_chars"), (F.col("__symbols"), "n_symbols"), (F.col("__dups"), "n_dup_lines"), (repeated, "n_repeat_words"))]
    return once(d.select("__row", F.struct(*long).alias("__stats")), {into: F.col("__stats")}).select(*[F.col("__row")[c].alias(c) for c in keep], into)


def base_failed(stats: str = "stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED_PERCENT * s["n_words"])


def ratios(stats: str = "stats") -> dict[str, Column]:
    """The statistics that rules compare, by name; zero for a text without a word."""
    s = F.col(stats)
    share = lambda a: F.coalesce(F.try_divide(s[a], s["n_words"]), F.lit(0.0))
    return {"word_length": share("word_chars"), "symbol_share": share("n_symbols"), "dup_line_share": share("n_dup_lines"),
            "repeat_share": share("n_repeat_words"), "words": s["n_words"].cast("double")}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.statistic] > self.threshold if self.above else values[self.statistic] <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction that marks a document as bad; what no rule covers is good."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule_number(self, values: dict[str, Column]) -> Column:
        """Number of the first rule that covers the row, from 1; null if none does."""
        case = F.lit(None).cast("int")
        for no, rule in reversed(list(enumerate(self.rules, 1))):
            case = F.when(_all(rule, values), F.lit(no)).otherwise(case)
        return case

    def __str__(self) -> str:
        return "\n".join(f"{no}. bad if " + " and ".join(map(str, rule)) for no, rule in enumerate(self.rules, 1)) or "no rule"


def _all(rule: tuple[Condition, ...], values: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.column(values) for c in rule), F.lit(True))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gained by a condition, times the bad documents that it still covers."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _best(table: DataFrame, edges: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition with the best gain on ``table``, with what it covers (bad, good)."""
    bins = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(f"bin_{s}").alias("bin")) for s in STATISTICS])
    counts = table.select("bad", F.explode(bins).alias("b")).groupBy("b.statistic", "b.bin").agg(
        F.sum(F.col("bad").cast("int")).alias("bad"), F.sum((~F.col("bad")).cast("int")).alias("good")).collect()
    best, top = (None, 0, 0), 1e-9
    for statistic in STATISTICS:
        own = {r.bin: (r.bad, r.good) for r in counts if r.statistic == statistic}
        bad_all, good_all = sum(b for b, _ in own.values()), sum(g for _, g in own.values())
        bad = good = 0
        for no, edge in enumerate(edges[statistic]):
            bad, good = bad + own.get(no, (0, 0))[0], good + own.get(no, (0, 0))[1]
            for above, b, g in ((False, bad, good), (True, bad_all - bad, good_all - good)):
                gain = _gain(b, g, bad_all, good_all)
                if gain > top:
                    best, top = (Condition(statistic, above, edge), b, g), gain
    return best


def _centred(table: DataFrame, condition: Condition) -> Condition:
    """The same condition with its threshold half way between the values next to it on either side."""
    value = F.col(condition.statistic)
    low, high = table.agg(F.max(F.when(value <= condition.threshold, value)), F.min(F.when(value > condition.threshold, value))).first()
    if low is None or high is None:
        return condition
    return Condition(condition.statistic, condition.above, (low + high) / 2)


def _worth(table: DataFrame, rule: tuple[Condition, ...], values: dict[str, Column]) -> list[tuple[int, int]]:
    """(bad, good) covered on ``table`` by each front part of a rule, in one pass."""
    sums = []
    for n in range(1, len(rule) + 1):
        hit = _all(rule[:n], values)
        sums += [F.sum((hit & F.col("bad")).cast("int")), F.sum((hit & ~F.col("bad")).cast("int"))]
    got = [x or 0 for x in table.agg(*sums).first()]
    return list(zip(got[::2], got[1::2], strict=True))


def learn_rules(labelled: DataFrame, stats: str = "stats", bad: str = "bad", key: str = "doc_id") -> DecisionList:
    """Learns from all rows of ``labelled`` with a non-null label: boolean ``bad`` and the struct of statistics."""
    columns = ratios(stats)
    rows = labelled.filter(F.col(bad).isNotNull()).select(F.col(bad).alias("bad"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("held"), *[c.alias(s) for s, c in columns.items()])
    rows = staged(rows, "labelled-stats")
    probabilities = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(s, probabilities, 10_000).alias(s) for s in STATISTICS]).first()
    if cuts[0] is None:
        return DecisionList()
    edges = {s: sorted({*cuts[s], 0.0}) for s in STATISTICS}
    bins = {f"bin_{s}": sum(((F.col(s) > e).cast("int") for e in edges[s]), F.lit(0)) for s in STATISTICS}
    rows = staged(rows.withColumns(bins), "labelled-bins")
    values, found = {s: F.col(s) for s in STATISTICS}, DecisionList()
    while len(found.rules) < MAX_RULES:
        left = rows.filter(found.rule_number(values).isNull()) if found.rules else rows
        grow, held = left.filter("not held"), left.filter("held")
        rule: tuple[Condition, ...] = ()
        while len(rule) < MAX_CONDITIONS:
            covered = grow.filter(_all(rule, values))
            condition, _, good = _best(covered, edges)
            if condition is None:
                break
            rule += (_centred(covered, condition),)
            if not good:
                break
        if not rule:
            break
        worth = _worth(held, rule, values)
        score = [(b - g) / (b + g) if b + g else -1.0 for b, g in worth]
        cut = max(range(len(rule)), key=lambda i: (score[i], -i)) + 1
        b, g = worth[cut - 1]
        if b + g < LEAST_COVERED or b < LEAST_PRECISION * (b + g):
            break
        found.rules.append(rule[:cut])
    return found


def judge(docs: DataFrame, rules: DecisionList, stats: str = "stats") -> tuple[Column, Column, Column]:
    """(base_failed, number of the covering rule, kept)."""
    failed, number = base_failed(stats), rules.rule_number(ratios(stats))
    return failed, number, ~failed & number.isNull()


def learn_and_judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """doc_id, the five statistics, base_failed, rule and kept of every row of ``docs``.

    ``labels`` has doc_id and quality (0 is bad, 1 good, null is no label).  Where an id has several labels the lowest
    counts.  The list is learned from the labelled rows that the base rule passes, so that it adds to it; without labels
    it is empty and the base rule decides alone.  A null or empty text has no words and fails the base rule.  Repeated rows
    give a row each; null ids stay null and are not learned from; columns of other names play no part, whatever they are
    called; an empty table gives no rows."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = staged(text_statistics(source).select("doc_id", "stats"), "text-stats")
    known = labels.filter(f"`{quality_col}` is not null").groupBy(F.col(id_col).alias("doc_id")).agg((F.min(quality_col) == 0).alias("bad"))
    rules = learn_rules(stats.join(known, "doc_id").filter(~base_failed()))
    failed, number, kept = judge(stats, rules)
    return stats.select("doc_id", "stats.*", failed.alias("base_failed"), number.alias("rule"), kept.alias("kept"))
