"""Scores, budgets and seeded draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the four criteria (sum 0.9), and the weight of redundancy, which is subtracted.
CRITERIA_WEIGHTS = {"story_value": 0.35, "visual_quality": 0.25, "context_value": 0.15, "transition_value": 0.15}
REDUNDANCY_WEIGHT = 0.30


def r6(c: Column | str) -> Column:
    """Six decimals, half to even."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 1e6) / 1e6


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def composite_score(raw: dict[str, Column], score: Column) -> Column:
    """Weighted criteria in [0, 10]; a row that has ``score`` but no criterion uses it (5.0 when it is no number).

    ``raw`` maps criterion names to text columns, null where the criterion is absent; a criterion that is present but
    not a number makes the result null."""
    present = [raw[name].isNotNull() for name in CRITERIA_WEIGHTS]
    any_criterion = present[0] | present[1] | present[2] | present[3]
    names = [*CRITERIA_WEIGHTS, "redundancy_penalty"]
    value = {n: F.when(raw[n].isNull(), F.lit(0.0)).otherwise(raw[n].try_cast("double")) for n in names}
    bad = value[names[0]].isNull()
    for n in names[1:]:
        bad = bad | value[n].isNull()
    total = F.lit(0.0)
    for n, w in CRITERIA_WEIGHTS.items():
        total = total + F.lit(w) * clamp(value[n], 0.0, 1.0)
    combined = F.greatest(F.lit(0.0), total - F.lit(REDUNDANCY_WEIGHT) * clamp(value["redundancy_penalty"], 0.0, 1.0)) * 10.0
    plain = F.coalesce(score.try_cast("double"), F.lit(5.0))
    return F.when(score.isNotNull() & ~any_criterion, plain).when(~bad, combined)


def word_limit(duration: Column, words_per_sec: float, tolerance: float) -> Column:
    return F.greatest(F.lit(1), F.floor(duration * F.lit(words_per_sec) * F.lit(tolerance)).cast("int"))


def seeded_uniform(key: Column) -> Column:
    """Uniform draw in [0, 1) that depends on ``key`` only, so retries and re-runs agree."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
