"""Highlight candidates: coercion, budgeted selection without overlaps, and the timeline of what is kept."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from ..functions.text import once
from ..functions.timecode import parse_timestamp
from ..params import HighlightParams
from ..session import stage
from .ranges import FOLD_LIMIT, asof, attach, chain_ids, split_by_size, spread
from .scan import Axis, RunSum, scan

KEY = "video_id"
ROW = "__row"
BLOCK_ROWS = 50_000  # candidates of a long chain that one task settles at a time


def coerce_highlights(raw: DataFrame, score: Column, t0: Column, t1: Column, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Candidates clamped to [t0, t1] with their score in [1, 10]; ``reason`` is null for accepted rows."""
    timed = once(raw, {"__s": parse_timestamp(F.col(start)), "__e": parse_timestamp(F.col(end)), "__score": score})
    s, e = F.greatest("__s", t0), F.least("__e", t1)
    bad = F.col("__s").isNull() | F.col("__e").isNull() | F.col("__score").isNull()
    reason = F.when(bad, "bad time or score").when(F.col("__e") <= F.col("__s"), "end before start").when(e <= s, "outside the window")
    ok = reason.isNull()
    return timed.select(*[c for c in raw.columns if c not in (start, end, "score")], F.when(ok, s).alias("start_sec"), F.when(ok, e).alias("end_sec"),
                        F.when(ok, clamp(F.col("__score"), 1.0, 10.0)).alias("score"), reason.alias("reason"))


def best_disjoint(cands: DataFrame, slack: float, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Best-first choice of candidates (video_id, ord, start_sec, end_sec, score) that do not overlap those chosen before.

    Candidates of different overlap chains do not meet, so each chain decides for itself: short ones by a fold, those
    above ``fold_limit`` in rounds that are distributed over time buckets and blocks."""
    cols = [KEY, "ord", "start_sec", "end_sec", "score"]
    chained = chain_ids(cands.select(*cols), Axis.time(KEY, ("start_sec", "end_sec", "ord")), "start_sec", "end_sec",
                        lambda s, reach: s >= reach - slack)
    chained = stage(chained)
    small, large = split_by_size(chained, [KEY], fold_limit)
    kept = _by_fold(small, slack)
    return kept if large is None else kept.unionByName(_by_rounds(large.select(*cols), slack))


def _by_fold(chained: DataFrame, slack: float) -> DataFrame:
    row = F.struct((-F.col("score")).alias("neg"), "ord", "start_sec", "end_sec")
    lists = chained.groupBy(KEY, "chain").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    zero = F.array().cast("array<struct<neg:double,ord:bigint,start_sec:double,end_sec:double>>")
    kept = F.aggregate("rows", zero, lambda acc, x: F.when(F.exists(
        acc, lambda c: (x["start_sec"] < c["end_sec"] - slack) & (x["end_sec"] > c["start_sec"] + slack)), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select(KEY, F.inline(kept)).select(KEY, "ord", "start_sec", "end_sec", (-F.col("neg")).alias("score"))


def _by_rounds(cands: DataFrame, slack: float, width: float = 5.0, block_rows: int | None = None) -> DataFrame:
    """Long chains.  While that settles half of what is left, the candidates that are best around them are accepted and
    what overlaps them goes; then blocks of time are settled whole.  Every row has a number of its own, so repeated rows
    are told apart; no row without a video gets here."""
    numbered = stage(cands.withColumn(ROW, F.monotonically_increasing_id()))
    active, left = numbered, numbered.count()
    accepted = numbered.limit(0)
    while left:
        winners, active = _local_winners(active, slack, width)
        accepted = accepted.unionByName(winners)
        before, left = left, active.count()
        if left > before / 2:
            accepted = accepted.unionByName(_by_blocks(active, slack, block_rows or BLOCK_ROWS))
            break
    return accepted.drop(ROW)


def _local_winners(active: DataFrame, slack: float, width: float) -> tuple[DataFrame, DataFrame]:
    """(candidates that are best in every time bucket they touch, those neither accepted nor overlapping one of these).

    Buckets only make the test stricter, so what is accepted the best-first order would take.  Of a bucket only one row
    is ever gathered."""
    placed = spread(active.withColumn("rank", F.struct((-F.col("score")).alias("neg"), "ord", ROW)), "start_sec", "end_sec", width)
    best = placed.groupBy(KEY, "__bucket").agg(F.min("rank").alias("best"))
    held = placed.join(best, [KEY, "__bucket"])
    won = held.groupBy(ROW).agg(F.bool_and(F.col("rank") == F.col("best")).alias("won")).filter("won").select(ROW)
    winners = stage(active.join(won, ROW, "left_semi"))
    wall = spread(winners.select(KEY, F.col("start_sec").alias("w_s"), F.col("end_sec").alias("w_e"), F.col(ROW).alias("w_row")), "w_s", "w_e", width)
    meets = (F.col("start_sec") < F.col("w_e") - slack) & (F.col("end_sec") > F.col("w_s") + slack)
    gone = placed.join(wall, [KEY, "__bucket"]).filter(meets | (F.col(ROW) == F.col("w_row"))).select(ROW).distinct()
    return winners, stage(active.join(gone, ROW, "left_anti"))


def _by_blocks(active: DataFrame, slack: float, block_rows: int) -> DataFrame:
    """Accepted candidates of ``active``, settled in rounds over blocks of about ``block_rows`` candidates each.

    A block settles every candidate whose fate depends on candidates inside it alone, however long the chain of rivals.
    One that reaches over a border is accepted if no block it touches holds a better rival that is accepted or open, and
    then comes first in the next round, where it drives out its rivals.  Borders move by half a block between rounds.
    So scores that rise or fall along a whole chain take a round per block, others a few rounds."""
    columns = active.columns
    active = active.withColumn("fixed", F.lit(False))
    kept, shift = [], 0
    while not active.filter("NOT fixed").isEmpty():
        rows = stage(_in_blocks(active, block_rows, shift))
        votes = _votes(rows, slack).groupBy(ROW).agg(F.min("vote").alias("vote"))
        voted = stage(rows.join(votes, ROW).filter("NOT fixed AND vote >= 0"))
        won = F.col("vote") == 1
        kept.append(voted.filter(won).select(*columns))
        again = voted.filter(~won | (F.col("__first") < F.col("__last")))
        active, shift = again.select(*columns, won.alias("fixed")), block_rows // 2 - shift
    return reduce(DataFrame.unionByName, kept) if kept else active.select(*columns)


def _in_blocks(active: DataFrame, block_rows: int, shift: int) -> DataFrame:
    """Adds the first and the last block of each candidate; borders lie between whole seconds of a video, where the count
    of candidates that start before passes a multiple of ``block_rows``."""
    second = F.floor("start_sec")
    order = Window.partitionBy(KEY).orderBy("__second")
    counts = active.groupBy(KEY, second.alias("__second")).agg(F.count("*").alias("__n"))
    part = F.floor((F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + shift) / block_rows)
    parts = counts.withColumn("__part", part)
    starts = parts.filter(F.col("__part") > 0).groupBy(KEY, "__part").agg(F.min("__second").cast("double").alias("__at"))
    borders = starts.groupBy(KEY).agg(F.collect_list("__at").alias("__borders"))

    def block(t: str) -> Column:
        return F.coalesce(F.size(F.filter("__borders", lambda at: at <= F.col(t))), F.lit(0))

    found = attach(active, borders, KEY)
    return found.withColumns({"__first": block("start_sec"), "__last": block("end_sec")}).drop("__borders")


def _votes(rows: DataFrame, slack: float) -> DataFrame:
    """What each block a candidate touches says of it: -1 a better rival is accepted, 1 no better rival is left, 0 open."""
    touched = rows.select(KEY, ROW, F.explode(F.sequence("__first", "__last")).alias("__block"), "start_sec", "end_sec",
                          (F.col("__first") == F.col("__last")).alias("inner"), "fixed", (-F.col("score")).alias("neg"), "ord")
    return touched.groupBy(KEY, "__block").applyInPandas(lambda block: _settle(block, slack), f"{ROW} long, vote int")


def _settle(block: pd.DataFrame, slack: float) -> pd.DataFrame:
    """Best-first order over one block.  Those accepted hardly overlap, so the last of them that start before the end of a
    candidate decide; the open ones are kept as a union of ranges."""
    ranked = block.sort_values(["fixed", "neg", "ord", ROW], ascending=[False, True, True, True])
    taken: list[tuple[float, float]] = []
    open_from: list[float] = []
    open_to: list[float] = []
    votes = []
    for start, end, inner, fixed in zip(*(ranked[c].tolist() for c in ("start_sec", "end_sec", "inner", "fixed"))):
        if not fixed and _meets_taken(taken, start, end, slack):
            votes.append(-1)
            continue
        at = bisect_left(open_from, end) - 1
        clear = fixed or at < 0 or open_to[at] <= start
        votes.append(int(clear))
        if fixed or (clear and inner):
            insort(taken, (start, end))
            continue
        lo, hi = bisect_left(open_to, start), bisect_right(open_from, end)
        if lo < hi:
            start, end = min(start, open_from[lo]), max(end, open_to[hi - 1])
        open_from[lo:hi], open_to[lo:hi] = [start], [end]
    return pd.DataFrame({ROW: ranked[ROW], "vote": votes})


def _meets_taken(taken: list[tuple[float, float]], start: float, end: float, slack: float) -> bool:
    """Of accepted ranges longer than twice the slack only the last that starts in time can meet; shorter ones are passed."""
    at = bisect_left(taken, (end,)) - 1
    while at >= 0:
        s, e = taken[at]
        if end > s + slack:
            if start < e - slack:
                return True
            if e - s > 2 * slack:
                return False
        at -= 1
    return False


def select_highlights(cands: DataFrame, budgets: DataFrame, params: HighlightParams = HighlightParams(),
                      fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Windows kept per video within its budget (``budgets``: video_id, budget_sec), best score first, input order on ties.

    The budget only cuts the best-first sequence short: the last window is trimmed to what is left unless it is the first."""
    valid = cands.filter(F.col("end_sec") > F.col("start_sec"))
    chosen = attach(best_disjoint(valid, params.touch_slack_sec, fold_limit), budgets, KEY, "inner").filter(F.col("budget_sec") > 0)
    ranked = stage(chosen.withColumns({"neg": -F.col("score"), "span": F.col("end_sec") - F.col("start_sec")}))
    axis = Axis((KEY,), ("neg", "ord"), F.floor(F.col("neg") * 20).cast("long"))
    used = scan(ranked, axis, RunSum("before", "span", inclusive=False))
    left = F.col("budget_sec") - F.col("before")
    end = F.when((F.col("span") > left) & (F.col("before") > 0), F.col("start_sec") + left).otherwise(F.col("end_sec"))
    return used.filter(F.col("before") < F.col("budget_sec")).select(KEY, "ord", "start_sec", end.alias("end_sec"), "score")


def with_fallback(selected: DataFrame, media: DataFrame) -> DataFrame:
    """Videos of which nothing was selected are kept whole; ``fallback`` marks them."""
    none = media.join(selected.select(KEY).distinct(), KEY, "left_anti").select(
        KEY, F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"), F.lit(True).alias("fallback"))
    return selected.select(KEY, "start_sec", "end_sec", F.lit(False).alias("fallback")).unionByName(none)


def kept_share(selected: DataFrame, media: DataFrame) -> DataFrame:
    sums = selected.groupBy(KEY).agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("kept_sec"), F.count("*").alias("windows"))
    return sums.join(media, KEY).withColumn("share", F.col("kept_sec") / F.greatest("duration_sec", F.lit(1e-6)))


def cutlist(selected: DataFrame) -> DataFrame:
    """Adds new_start: where each kept window lies once they are joined."""
    return scan(selected, Axis.time(KEY, ("start_sec", "end_sec"), 60.0),
                RunSum("new_start", F.col("end_sec") - F.col("start_sec"), inclusive=False))


def map_to_cutlist(points: DataFrame, windows: DataFrame, t: str = "t_sec") -> DataFrame:
    """Adds new_sec: the time of a point in the joined video, null where it was cut out.

    Kept windows may share up to the touch slack; there the later window counts, so a point has one time only."""
    marks = windows.select(KEY, F.col("start_sec").alias("w_start"), F.col("end_sec").alias("w_end"), "new_start")
    found = asof(points, marks, KEY, t, "w_start", ["w_start", "w_end", "new_start"])
    inside = F.col(t) < F.col("w_end")
    return found.withColumn("new_sec", F.when(inside, F.col("new_start") + (F.col(t) - F.col("w_start")))).drop("w_start", "w_end", "new_start")
