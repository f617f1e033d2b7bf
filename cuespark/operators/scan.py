"""Ordered scans that stay balanced when one key holds a large share of the rows, and that lose no row.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task.  Here the order of a key is cut
into *slabs* (``floor(t / width)``): the window runs per (key, slab), each slab is reduced to one row, a window over
those few rows yields what enters each slab from before (or after), and a join on (key, slab) adds it.

Key and slab travel as one struct, which is never null and equal where its fields are equal or both null.  So rows
without a key form a key of their own, and rows without a time come before all others of their key.  The rows are dealt
once, by that struct; the reduction, the window and the join all read that one exchange.

A slab may still hold too many rows for one task.  Above ``cuespark.scan.slabRows`` rows (5,000,000 unless set, 0 for
never), found by counting a sample where the input is large enough to have such slabs, it is cut further in time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLAB = "__slab"
DEFAULT_SLAB_SEC = 2.0
SLAB_ROWS_CONF, SLAB_ROWS = "cuespark.scan.slabRows", 5_000_000
SAMPLE_SHARE, BYTES_OF_ROW = 0.01, 4


@dataclass(frozen=True)
class Axis:
    """Key columns, total order within a key, and a slab expression that never decreases along it."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    slab: Column

    def at(self, sub: Column | None = None) -> Column:
        return F.struct(*self.keys, self.slab.alias("slab"), (F.lit(0) if sub is None else F.coalesce(sub, F.lit(0))).cast("long").alias("sub"))

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` with its column of key and slab, dealt out by it."""
        return self._marked(df).repartition(SLAB)

    def _marked(self, df: DataFrame) -> DataFrame:
        limit = int(df.sparkSession.conf.get(SLAB_ROWS_CONF, str(SLAB_ROWS)))
        whole = df.withColumn(SLAB, self.at())
        if limit <= 0 or _input_bytes(df) < limit * BYTES_OF_ROW:
            return whole
        share = min(1.0, max(SAMPLE_SHARE, 1000 / limit))
        first = F.col(self.order[0]).cast("double")
        sample = whole.sample(share, 1) if share < 1 else whole
        heavy = sample.groupBy(F.col(SLAB).alias("__at")).agg(F.count("*").alias("__n"), F.min(first).alias("__lo"), F.max(first).alias("__hi"))
        heavy = heavy.filter(F.col("__n") > limit * share).select("__at", F.ceil(F.col("__n") / (limit * share)).alias("__parts"), "__lo", "__hi")
        rows = heavy.take(MOST_CUT + 1)
        if not rows:
            return whole
        few = df.sparkSession.createDataFrame(rows, heavy.schema)
        marked = whole.join(F.broadcast(few) if len(rows) <= MOST_CUT else heavy, F.col(SLAB) == F.col("__at"), "left")
        place = (first - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
        sub = F.greatest(F.lit(0), F.least(F.floor(place * F.col("__parts")), F.col("__parts") - 1))
        return marked.withColumn(SLAB, self.at(sub)).drop("__at", "__parts", "__lo", "__hi")

    @staticmethod
    def time(keys: str | Sequence[str], order: str | Sequence[str], width: float = DEFAULT_SLAB_SEC) -> Axis:
        keys = (keys,) if isinstance(keys, str) else tuple(keys)
        order = (order,) if isinstance(order, str) else tuple(order)
        return Axis(keys, order, F.floor(F.col(order[0]) / F.lit(float(width))).cast("long"))


#: The list of slabs to cut has at most rows / limit entries; up to this many it is broadcast.
MOST_CUT = 10_000


def _input_bytes(df: DataFrame) -> int:
    """Size of all that a table is computed from, as the optimizer knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def reduced(based: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One row per slab: its key columns and ``aggs``.  Reads all columns, so that it can share the exchange of the rows."""
    touched = F.max(F.xxhash64(*[c for c in based.columns if not c.startswith("__")])).alias("__touched")
    whole = based.groupBy(SLAB).agg(*aggs, touched).filter("__touched IS NOT NULL").drop("__touched")
    return whole.select(SLAB, *[F.col(f"{SLAB}.{k}").alias(k) for k in keys], *[c for c in whole.columns if c != SLAB])


class Lag:
    """Value of ``expr`` on the row before (after, with ``ahead``); null at the end of the key."""

    def __init__(self, name: str, expr: Column | str, ahead: bool = False):
        self.name, self.expr, self.ahead = name, _col(expr), ahead

    def local(self, w):
        step = F.lead if self.ahead else F.lag
        return step(F.struct(self.expr.alias("v"))).over(w)

    def partial(self, order):
        edge = F.min_by if self.ahead else F.max_by
        return edge(F.struct(self.expr.alias("v")), order)

    def carry(self, part, sw, _whole):
        return (F.lead if self.ahead else F.lag)(part).over(sw)

    def final(self, local, carry):
        return F.coalesce(local, carry)["v"]


class Lead(Lag):
    def __init__(self, name: str, expr: Column | str):
        super().__init__(name, expr, ahead=True)


class RunSum:
    """Running sum up to and including the row (``inclusive=False``: up to the row before)."""

    def __init__(self, name: str, expr: Column | str, inclusive: bool = True):
        self.name, self.expr, self.inclusive = name, _col(expr), inclusive

    def local(self, w):
        return F.sum(self.expr).over(w.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1))

    def partial(self, _order):
        return F.sum(self.expr)

    def carry(self, part, sw, _whole):
        return F.sum(part).over(sw.rowsBetween(Window.unboundedPreceding, -1))

    def final(self, local, carry):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))


class RowNumber(RunSum):
    def __init__(self, name: str):
        super().__init__(name, F.lit(1).cast("long"))


class RunMax:
    """Running maximum; null while nothing came before."""

    def __init__(self, name: str, expr: Column | str, inclusive: bool = True):
        self.name, self.expr, self.inclusive = name, _col(expr), inclusive

    def local(self, w):
        return F.max(self.expr).over(w.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1))

    def partial(self, _order):
        return F.max(self.expr)

    def carry(self, part, sw, _whole):
        return F.max(part).over(sw.rowsBetween(Window.unboundedPreceding, -1))

    def final(self, local, carry):
        return F.greatest(local, carry)


class RunLast:
    """Latest non-null value up to the row (``ahead``: first non-null value from the row on)."""

    def __init__(self, name: str, expr: Column | str, ahead: bool = False):
        self.name, self.expr, self.ahead = name, _col(expr), ahead

    def local(self, w):
        if self.ahead:
            return F.first(self.expr, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return F.last(self.expr, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def partial(self, order):
        return (F.min_by if self.ahead else F.max_by)(self.expr, F.when(self.expr.isNotNull(), order))

    def carry(self, part, sw, _whole):
        if self.ahead:
            return F.first(part, ignorenulls=True).over(sw.rowsBetween(1, Window.unboundedFollowing))
        return F.last(part, ignorenulls=True).over(sw.rowsBetween(Window.unboundedPreceding, -1))

    def final(self, local, carry):
        return F.coalesce(local, carry)


class Total:
    """Aggregate over the whole key, delivered to every row without a join on the key alone."""

    def __init__(self, name: str, expr: Column | str, fn=F.sum):
        self.name, self.expr, self.fn = name, _col(expr), fn

    def local(self, _w):
        return None

    def partial(self, _order):
        return self.fn(self.expr)

    def carry(self, part, _sw, whole):
        return self.fn(part).over(whole)

    def final(self, _local, carry):
        return carry


def scan(df: DataFrame, axis: Axis, *specs) -> DataFrame:
    """Adds one column per spec; every other column of ``df`` is kept."""
    keys = list(axis.keys)
    based = axis.cut(df)
    order = F.struct(*axis.order)
    local_w = Window.partitionBy(SLAB).orderBy(*axis.order)
    slab_w = Window.partitionBy(*keys).orderBy(SLAB)
    whole = Window.partitionBy(*keys)

    summary = reduced(based, keys, [s.partial(order).alias(f"__p{i}") for i, s in enumerate(specs)])
    carried = summary.select(SLAB, *[s.carry(F.col(f"__p{i}"), slab_w, whole).alias(f"__c{i}") for i, s in enumerate(specs)])
    locals_ = [(i, s.local(local_w)) for i, s in enumerate(specs)]
    rows = based.select("*", *[c.alias(f"__l{i}") for i, c in locals_ if c is not None])
    joined = rows.join(carried, SLAB)
    has_local = {i for i, c in locals_ if c is not None}
    finals = {
        s.name: s.final(F.col(f"__l{i}") if i in has_local else None, F.col(f"__c{i}")) for i, s in enumerate(specs)
    }
    kept = [c for c in df.columns if c not in finals]
    return joined.select(*kept, *[c.alias(n) for n, c in finals.items()])


def _col(expr: Column | str) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr
