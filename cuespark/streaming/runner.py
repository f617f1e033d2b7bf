"""Running streaming jobs to the end of their input: file input with admission control, a sink in the shared folder, a
read-back.  Admission control bounds the size of a micro-batch; no result depends on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import new_folder, remove_folder, scratch, stage, subfolders

MAX_BYTES_PER_TRIGGER = 256 * 1024 * 1024


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run; a long-lived job passes its own fixed folder instead."""
    return new_folder(spark, name)


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet input as a stream.  The size of a micro-batch, and so of any group within it, is bounded.

    The path is given as a pattern that matches itself: a stream takes a single file only in that form, and a folder of
    files in either."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", MAX_BYTES_PER_TRIGGER).parquet(pattern)


def _finish(query) -> None:
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure


def drain(stream: DataFrame, name: str, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there now into a Parquet table and returns that table."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
    _finish(writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, name: str, folder: str | None = None, mode: str = "append",
                  each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As ``drain`` through foreachBatch.  Every batch owns the folder named by its id and replaces it when it is run
    again, so a restart after a failure writes nothing twice.  The table has the column batch_id."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    _finish(writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").withColumn("batch_id", F.col("batch_id").cast("long"))


FINAL = "__final"
ARRIVED, ENDED = "__arrived", "__ended"  # kept with every row of a state: the batch that brought it, mark of an ended key


@dataclass(frozen=True)
class Lifetime:
    """How long a keyed job holds its rows.

    ``t`` is the event time (a number; rows without one are never late), and the watermark of a batch the newest time so far
    less ``delay``.  ``final(rows, watermark)`` returns the rows with the boolean column ``FINAL``: true where the rows still
    to come, all at or after the watermark, cannot change what the job makes of this one, and where no other row needs it.
    With ``linger`` keys are final as a whole; what one brings after that, up to ``linger`` after its first row, is ignored."""

    t: Column
    delay: float
    final: Callable[[DataFrame, float], DataFrame]
    linger: float | None = None


def drain_keyed(stream: DataFrame, name: str, key: str, compute: Callable[[DataFrame], DataFrame], folder: str | None = None,
                life: Lifetime | None = None) -> DataFrame:
    """Runs the stream over what is there now; returns what ``compute`` makes of all rows read in this run and earlier ones.

    The state is a table.  Every micro-batch writes the rows that are still open together with its own, and adds the results
    of rows that have become final to ``out``, so it costs what it brings and what is open, however many batches came before.
    The states before the last two are removed.  A repeated batch starts from the state before it and replaces its own
    folders.  Rows behind the watermark of the batch before are late: they are set aside (``late_of``) and not applied.
    Without a ``life`` every row stays open, none is late, and a batch only appends.

    ``compute`` gets the open part of whole keys (null is one)."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumns({ARRIVED: F.lit(batch_id).cast("long"), ENDED: F.lit(False)})
        if life is None:
            fresh.write.mode("overwrite").parquet(_part(folder, "rows", batch_id))
        else:
            with scratch(spark):
                _advance(fresh, batch_id, key, compute, folder, life)

    writer = stream.writeStream.outputMode("append").foreachBatch(write)
    _finish(writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    rest = compute(open_rows(spark, folder, stream.schema, life is not None))
    if not subfolders(spark, f"{folder}/out"):
        return rest
    return spark.read.schema(rest.schema).parquet(f"{folder}/out").select(rest.columns).unionByName(rest)


def _part(folder: str, table: str, batch_id: int) -> str:
    return f"{folder}/{table}/batch_id={batch_id}"


def _state_schema(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add(ARRIVED, "long").add(ENDED, "boolean")


def _advance(fresh: DataFrame, batch_id: int, key: str, compute, folder: str, life: Lifetime) -> None:
    """One micro-batch: from the open rows and the watermark of the batch before to its own."""
    spark, columns, before, rows = fresh.sparkSession, fresh.columns, None, fresh
    if batch_id > 0:
        before = spark.read.parquet(_part(folder, "mark", batch_id - 1)).first()["watermark"]
        held = spark.read.schema(fresh.schema).parquet(_part(folder, "rows", batch_id - 1))
        if life.linger is not None:
            ended = held.filter(ENDED).select(F.col(key).alias("__key"))
            rows = rows.join(ended, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        if before is not None:
            late = F.coalesce(life.t < F.lit(before), F.lit(False))
            rows.filter(late).write.mode("overwrite").parquet(_part(folder, "late", batch_id))
            rows = rows.filter(~late)
        rows = held.unionByName(rows)
    rows = stage(rows)
    newest = fresh.agg(F.max(life.t)).first()[0]
    known = [w for w in (before, None if newest is None else newest - life.delay) if w is not None]
    watermark = max(known, default=None)
    live = rows.filter(~F.col(ENDED))
    judged = live.withColumn(FINAL, F.lit(False)) if watermark is None else life.final(live, watermark)
    judged = stage(judged.select(*columns, FINAL))
    done, kept = judged.filter(FINAL).drop(FINAL), judged.filter(~F.col(FINAL)).drop(FINAL)
    if life.linger is not None and watermark is not None:
        first = done.groupBy(key).agg(F.min_by(F.struct(*columns), life.t).alias("__first")).select("__first.*")
        marks = first.withColumn(ENDED, F.lit(True)).unionByName(rows.filter(ENDED))
        kept = kept.unionByName(marks.filter(life.t + life.linger > F.lit(watermark)))
    if not done.isEmpty():
        compute(done.drop(ARRIVED, ENDED)).write.mode("overwrite").parquet(_part(folder, "out", batch_id))
    kept.write.mode("overwrite").parquet(_part(folder, "rows", batch_id))
    mark = spark.range(1).select(F.lit(watermark).cast("double").alias("watermark"))
    mark.write.mode("overwrite").parquet(_part(folder, "mark", batch_id))
    for table in ("rows", "mark"):  # a repeated batch needs the one before it and no other
        remove_folder(spark, _part(folder, table, batch_id - 2))


def _batches(spark: SparkSession, folder: str, table: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in subfolders(spark, f"{folder}/{table}"))


def open_rows(spark: SparkSession, folder: str, schema: StructType, last_only: bool = True) -> DataFrame:
    """The rows that are not final: the state of the last batch, or those of all batches where each only appends."""
    found = _batches(spark, folder, "rows")
    if not found:
        return spark.createDataFrame([], schema)
    paths = [_part(folder, "rows", b) for b in (found[-1:] if last_only else found)]
    return spark.read.schema(_state_schema(schema)).parquet(*paths).filter(~F.col(ENDED)).drop(ARRIVED, ENDED)


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that a ``drain_keyed`` without a lifetime has read, with their batch_id."""
    return spark.read.parquet(f"{folder}/rows").drop("batch_id", ENDED).withColumnRenamed(ARRIVED, "batch_id")


def late_of(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows that were set aside as late, with the batch_id that brought them."""
    if not subfolders(spark, f"{folder}/late"):
        return spark.createDataFrame([], StructType(list(schema.fields)).add("batch_id", "long"))
    return spark.read.schema(_state_schema(schema)).parquet(f"{folder}/late").drop("batch_id", ENDED).withColumnRenamed(ARRIVED, "batch_id")
