"""Interval algebra: merging, point and range joins, and the splitting of chains at points that do not depend on the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .scan import DEFAULT_SLAB_SEC, SLAB, Axis, RunLast, reduced, scan

BUCKET = "__bucket"
FOLD_LIMIT = 2000  # rows of one chain up to which a fold in a single task is used


def bucket_of(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width))).cast("long")


def spread(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """One row per time bucket that the closed range [start, end] touches."""
    first, last = bucket_of(F.col(start), width), bucket_of(F.col(end), width)
    return df.withColumn(BUCKET, F.explode(F.sequence(first, F.greatest(first, last))))


def point_in_range(points: DataFrame, ranges: DataFrame, key: str, t: str, start: str, end: str, condition: Column,
                   how: str = "left", width: float = 60.0) -> DataFrame:
    """Equi join on (key, time bucket) with ``condition`` on top; column names of both sides must differ but for the key."""
    left = points.withColumn(BUCKET, bucket_of(F.col(t), width))
    right = spread(ranges, start, end, width).withColumnsRenamed({key: "__rkey", BUCKET: "__rbucket"})
    on = (F.col(key) == F.col("__rkey")) & (F.col(BUCKET) == F.col("__rbucket")) & condition
    return left.join(right, on, how).drop(BUCKET, "__rkey", "__rbucket")


def overlapping(left: DataFrame, right: DataFrame, key: str, lspan: tuple[str, str], rspan: tuple[str, str],
                condition: Column, width: float = 60.0) -> DataFrame:
    """Overlapping pairs of two range tables.  A pair meets in several buckets; only the first common one counts."""
    a = spread(left, *lspan, width)
    b = spread(right, *rspan, width).withColumnsRenamed({key: "__rkey", BUCKET: "__rbucket"})
    first_common = F.greatest(bucket_of(F.col(lspan[0]), width), bucket_of(F.col(rspan[0]), width))
    on = (
        (F.col(key) == F.col("__rkey")) & (F.col(BUCKET) == F.col("__rbucket"))
        & (F.col(BUCKET) == first_common) & condition
    )
    return a.join(b, on).drop(BUCKET, "__rkey", "__rbucket")


def neighbours(points: DataFrame, marks: DataFrame, key: str | tuple[str, ...], t: str, at: str, payload: list[str],
               ahead: bool = True, width: float = DEFAULT_SLAB_SEC, level_first: bool = True) -> DataFrame:
    """For each point the latest mark at or before it (``prev_`` columns) and the first one after it (``next_``), null if
    none: one ordered scan over both tables, no join on the key.  With ``level_first=False`` a mark at the very time of a
    point counts as after it."""
    keys = [key] if isinstance(key, str) else list(key)
    kinds = (0, 1) if level_first else (1, 0)
    m = marks.select(*keys, F.col(at).cast("double").alias("__t"), F.lit(kinds[0]).alias("__kind"), F.struct(*payload).alias("__mark"))
    row = F.struct(*[F.col(c) for c in points.columns])
    p = points.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(kinds[1]).alias("__kind"), row.alias("__row"))
    both = m.unionByName(p, allowMissingColumns=True)
    specs = [RunLast("__prev", "__mark")] + ([RunLast("__next", "__mark", ahead=True)] if ahead else [])
    found = scan(both, Axis.time(keys, ("__t", "__kind"), width), *specs).filter(F.col("__kind") == kinds[1])
    sides = ["prev", "next"] if ahead else ["prev"]
    return found.select(*[F.col(f"__row.{c}").alias(c) for c in points.columns],
                        *[F.col(f"__{side}.{c}").alias(f"{side}_{c}") for side in sides for c in payload])


def asof(points: DataFrame, marks: DataFrame, key: str, t: str, at: str, payload: list[str],
         width: float = DEFAULT_SLAB_SEC) -> DataFrame:
    """For each point the latest mark at or before it."""
    found = neighbours(points, marks, key, t, at, payload, ahead=False, width=width)
    return found.withColumnsRenamed({f"prev_{c}": c for c in payload})


def attach(rows: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Adds per-key facts (one row per key) to many rows.  Both sides are dealt by the key for this join alone, so that
    adaptive execution can split a hot key, or broadcast the facts where they turn out small.  A null key matches itself."""
    found = facts.withColumnRenamed(key, "__key")
    return rows.join(found, F.col(key).eqNullSafe(F.col("__key")), how).drop("__key")


def chain_ids(df: DataFrame, axis: Axis, start: str, end: str, opens, name: str = "chain", reach_as: str | None = None) -> DataFrame:
    """Adds ``name``: the row that opens the chain of overlapping ranges a row belongs to (as a struct of the order columns).

    ``opens(start, reach)`` says whether a range starts a new chain given the furthest end before it; it must stay true
    for any later start.  One pass: inside a slab the latest local opener is the true one unless what reaches in from
    earlier slabs covers it, and then every earlier opener of that slab is covered too.  ``reach_as`` also delivers the
    furthest end before each row."""
    keys = list(axis.keys)
    w = Window.partitionBy(SLAB).orderBy(*axis.order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.struct(*axis.order, F.col(start).alias("__s"))
    local = axis.cut(df).withColumn("__reach", F.max(end).over(before))
    local = local.withColumn("__open", F.when(F.col("__reach").isNull() | F.coalesce(opens(F.col(start), F.col("__reach")), F.lit(True)), mark))
    summary = reduced(local, keys, [F.max(end).alias("__end"), F.max("__open").alias("__last")])
    sw = Window.partitionBy(*keys).orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("__into", F.max("__end").over(sw))
    true_last = F.when(F.col("__into").isNull() | opens(F.col("__last.__s"), F.col("__into")), F.col("__last"))
    carried = carried.withColumn("__true", true_last).select(
        SLAB, "__into", F.last("__true", ignorenulls=True).over(sw).alias("__carried"))
    rows = local.withColumn("__mine", F.last("__open", ignorenulls=True).over(upto)).drop("__open")
    own = F.col("__into").isNull() | opens(F.col("__mine.__s"), F.col("__into"))
    picked = F.when(own, F.col("__mine")).otherwise(F.col("__carried"))
    reach = [F.greatest("__reach", "__into").alias(reach_as)] if reach_as else []
    return rows.join(carried, SLAB).select(*df.columns, *reach, F.struct(*[picked[o].alias(o) for o in axis.order]).alias(name))


def reset_ids(df: DataFrame, axis: Axis, needs: list[str], resets, name: str = "chain", prev_as: dict[str, str] | None = None) -> DataFrame:
    """Adds ``name``: the latest row (order columns) at or before each row that ``resets(cur, prev)`` picks, where both
    arguments give a column of the row or of the row before it; the first row of a key always resets.  One pass.

    ``prev_as`` also delivers columns of the previous row under new names."""
    keys = list(axis.keys)
    w = Window.partitionBy(SLAB).orderBy(*axis.order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    order, seen = F.struct(*axis.order), F.struct(*needs)
    local = axis.cut(df).withColumn("__prev", F.lag(seen).over(w))
    cur = F.col
    hit = F.col("__prev").isNull() | F.coalesce(resets(cur, lambda c: F.col("__prev")[c]), F.lit(False))
    local = local.withColumn("__open", F.when(hit, order))
    summary = reduced(local, keys, [
        F.min_by(seen, order).alias("__f"), F.max_by(seen, order).alias("__l"), F.min(order).alias("__fo"), F.max("__open").alias("__last")])
    sw = Window.partitionBy(*keys).orderBy(SLAB)
    carried = summary.withColumn("__cprev", F.lag("__l").over(sw))
    carried = carried.withColumn("__fhit", F.col("__cprev").isNull() | F.coalesce(
        resets(lambda c: F.col("__f")[c], lambda c: F.col("__cprev")[c]), F.lit(False)))
    carried = carried.withColumn("__true", F.when((F.col("__last") != F.col("__fo")) | F.col("__fhit"), F.col("__last")))
    carried = carried.select(SLAB, "__cprev", "__fhit", "__fo", F.last("__true", ignorenulls=True).over(
        sw.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    rows = local.withColumn("__mine", F.last("__open", ignorenulls=True).over(upto)).drop("__open")
    picked = F.when((F.col("__mine") != F.col("__fo")) | F.col("__fhit"), F.col("__mine")).otherwise(F.col("__carried"))
    before = F.coalesce("__prev", "__cprev")
    extra = [before[c].alias(n) for c, n in (prev_as or {}).items()]
    return rows.join(carried, SLAB).select(*df.columns, *extra, picked.alias(name))


def merge_ranges(df: DataFrame, key: str | tuple[str, ...], start: str = "start_sec", end: str = "end_sec", gap: float = 0.0,
                 extra: dict[str, Column] | None = None, width: float = DEFAULT_SLAB_SEC, tie: str | None = None) -> DataFrame:
    """Union of ranges; two are joined when the next start minus the running end is below ``gap`` (strictly).

    Ranges equal in start, end and ``tie`` are interchangeable, so their mutual order does not matter."""
    keys = [key] if isinstance(key, str) else list(key)
    order = (start, end) if tie is None else (start, end, tie)
    chained = chain_ids(df, Axis.time(key, order, width), start, end, lambda s, reach: s - reach >= F.lit(gap), "__chain")
    aggs = [F.min(start).alias(start), F.max(end).alias(end), *[c.alias(n) for n, c in (extra or {}).items()]]
    return chained.groupBy(*keys, "__chain").agg(*aggs).drop("__chain")


def split_by_size(chained: DataFrame, keys: list[str], limit: int, name: str = "chain") -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most ``limit`` rows, the other rows or None if there are none)."""
    big = chained.groupBy(*keys, name).count().filter(F.col("count") > limit).select(*keys, name)
    if big.isEmpty():
        return chained, None
    on = [*keys, name]
    return chained.join(big, on, "left_anti"), chained.join(big, on, "left_semi")


def follow(links: DataFrame, keys: list[str], node: str, after: str) -> DataFrame:
    """Nodes visited from the first node of every group along ``node`` -> ``after`` (null at the end).

    The path is doubled in every round: with the first 2^k nodes and the 2^k-fold jump at hand, one join gives the next
    2^k nodes and one the longer jump.  All joins are on (group, node), which no group can overload."""
    jump = stage(links.select(*keys, node, after))
    visited = stage(jump.groupBy(*keys).agg(F.min(node).alias(node)))
    while True:
        jump = jump.filter(F.col(after).isNotNull())
        reached = stage(visited.join(jump, [*keys, node]).select(*keys, F.col(after).alias(node)))
        if reached.isEmpty():
            return visited
        visited = visited.unionByName(reached)
        jump = stage(jump.join(jump.select(*keys, F.col(node).alias(after), F.col(after).alias("__far")), [*keys, after]).select(
            *keys, node, F.col("__far").alias(after)))
