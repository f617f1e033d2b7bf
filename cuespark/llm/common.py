"""Shared by the operators: tables in the shared folder, joins that survive hot keys, connected components, row selection."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space and words as the contracts define them: six ASCII characters separate words, nothing else does.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_RUN = f"llm-{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession) -> str:
    """A folder of this process below ``spark.checkpoint.dir``, which the cluster names and all executors share.

    Only a session with a local master may go without the setting; it then gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{_RUN}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that nothing reads any more; a session that has ended leaves it to the folder's owner."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, lost executors start from it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_of(table: DataFrame) -> str:
    return os.path.dirname(table.inputFiles()[0]) if table.inputFiles() else ""


def text_key(text: Column) -> Column:
    """Tells texts of one document id apart; null and empty differ."""
    return F.xxhash64(text, F.length(text))


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, heavy: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one fact row per key, where ``weight`` says how many of ``rows`` have the key.

    Keys with at least a ``heavy``-th of all rows number ``heavy`` at most, so those facts are broadcast with a proven
    bound; the others are joined by a shuffle in which no key is hot.  ``key`` is never null."""
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * heavy >= F.lit(total)
    few = F.broadcast(facts.filter(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(facts.filter(~hot), key))


def keyed(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Whole rows as ``__row`` with ``__key``, a struct of the given columns in which null equals null."""
    return docs.select(F.struct("*").alias("__row"), F.struct(*[F.struct(c.alias("x")).alias(n) for n, c in keys.items()]).alias("__key"))


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def _keys_of(kept: DataFrame, keys: dict[str, Column], *more: str) -> DataFrame:
    return kept.select(F.struct(*[F.struct(F.col(n).alias("x")).alias(n) for n in keys]).alias("__key"), *more)


def keep_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """All rows of ``docs`` whose keys ``kept`` has, repeated ones too.  ``keys`` names the columns of ``kept`` and says how
    they come from ``docs``.  The texts move once, to meet the kept keys."""
    return _columns(keyed(docs, keys).join(_keys_of(kept, keys), "__key", "left_semi"), docs)


def keep_first(docs: DataFrame, rows: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One row of ``docs`` for each key of ``kept``; where ``rows`` (the keys of all rows) repeats a key, the row with the
    smallest hash of all its columns.  Only rows with kept keys are compared."""
    found = keyed(docs, keys).join(_keys_of(kept, keys), "__key", "left_semi")
    if rows.groupBy(*keys).count().filter("count > 1").limit(1).count():
        found = found.groupBy("__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return _columns(found, docs)


def repeat_rows(docs: DataFrame, uses: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` as often as ``uses`` (the keys, copies) says.  Rows with equal keys share their copies evenly."""
    d = keyed(docs, keys)
    n = d.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1")
    uses = staged(_keys_of(uses, keys, "copies").join(n, "__key", "left"), "uses")
    single = d.join(uses.filter("__n is null"), "__key").select("__row", "copies")
    several = uses.filter("__n is not null")
    if several.limit(1).count():  # numbered in two steps, so that no key is sorted in one task
        spread = staged(d.join(several, "__key").withColumn("__salt", (F.rand(7) * 64).cast("int")), "repeated")
        before = Window.partitionBy("__key").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
        starts = spread.groupBy("__key", "__salt").count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        no = F.row_number().over(Window.partitionBy("__key", "__salt").orderBy("__salt")) - 1 + F.col("__start")
        share = F.expr("copies div __n") + (no < F.col("copies") % F.col("__n")).cast("int")
        single = single.unionByName(spread.join(starts, ["__key", "__salt"]).select("__row", share.cast("int").alias("copies")).filter("copies > 0"))
    return _columns(single.select("__row", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an undirected edge table: root is the smallest node that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"): each
    step hangs neighbours under the smallest node seen, and a logarithmic number of steps leaves stars.  Every step is a
    grouped minimum, which is combined before the shuffle, and a join; the table between steps is written, so that a lost
    executor costs one step."""
    table = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        now = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = staged(small.select("e.*").filter("u <> v").distinct(), "edges")
        discard(table.sparkSession, path_of(table))
        table = after
    roots = table.select(F.col("v").alias("node")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
