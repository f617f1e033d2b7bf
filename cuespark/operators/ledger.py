"""Stage ledger: fingerprints, what is done, what comes next, and what may be reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "video_id"
CHUNK = (KEY, "chunk_index")
# The four stages in order.
STAGES = ("01_extracted", "02_script", "03_tts_done", "04_assembled")
#: Rows that one task gets to group, sort and join.
TASK_ROWS = 1_000_000


def by_chunk(rows: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Rows dealt out by chunk to as many tasks as their number asks for, so that a task's memory does not follow the input.

    What groups or joins by chunk afterwards needs no further exchange, and adaptive execution, which goes by the bytes
    before a chunk becomes a row for each stage, does not put the parts together again.  The rows are counted for it: from
    the footers alone where they are a Parquet table."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (task_rows or TASK_ROWS)))
    return rows.repartition(tasks, *CHUNK)


def fingerprint(fields: dict[str, Column]) -> Column:
    """12 hex digits over the JSON of all result-affecting fields, sorted by name."""
    return F.substring(F.sha1(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))), 1, 12)


def stage_order(stage: Column) -> Column:
    """1..4, null for an unknown stage."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(0).cast("long")).cast("int")


def recorded(ledger: DataFrame, payloads: DataFrame) -> DataFrame:
    """Ledger rows whose payload exists."""
    return ledger.join(payloads, [*CHUNK, "stage"], "left_semi")


def status_matrix(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per planned chunk with four booleans, ``done``, and the first missing stage (null when complete)."""
    flags = done.groupBy(*CHUNK).agg(*[F.bool_or(F.col("stage") == s).alias(f"s{i}") for i, s in enumerate(STAGES, 1)])
    m = chunks.join(flags, list(CHUNK), "left")
    named = dict(zip(("has_frames", "has_script", "has_speech", "has_audio"), (f"s{i}" for i in range(1, 5))))
    m = m.select(*chunks.columns, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in named.items()])
    nxt = None
    for n, s in zip(named, STAGES):
        nxt = F.when(~F.col(n), s) if nxt is None else nxt.when(~F.col(n), s)
    return m.withColumns({"done": F.col("has_audio"), "next_stage": nxt})


def status_summary(matrix: DataFrame) -> DataFrame:
    """Per video: chunks done, readiness flags, first unfinished chunk and completed steps (0..5 as steps open in order)."""
    s = matrix.groupBy(KEY).agg(
        F.count("*").alias("chunks"), F.count_if("done").alias("chunks_done"), F.bool_and("has_frames").alias("all_frames"),
        F.bool_and("has_script").alias("all_scripts_ready"), F.bool_and("has_speech").alias("all_speech_ready"),
        F.bool_and("done").alias("all_done"), F.coalesce(F.min(F.when(~F.col("done"), F.col("chunk_index"))), F.max("chunk_index")).alias("first_unfinished"))
    a, b, c, e = F.col("all_frames"), F.col("all_scripts_ready"), F.col("all_speech_ready"), F.col("all_done")
    steps = F.when(~a, 1).when(~b, 2).when(~c, 3).when(~e, 4).otherwise(5)
    return s.withColumn("steps_complete", steps).drop("all_frames", "all_done")


def invalidate_from(ledger: DataFrame, orders: DataFrame) -> DataFrame:
    """Ledger without the named stage and all later ones of the named chunks (``orders``: video_id, chunk_index, from_stage)."""
    first = orders.groupBy(*CHUNK).agg(F.min(stage_order(F.col("from_stage"))).alias("__first"))
    return ledger.join(first, list(CHUNK), "left").filter(
        F.col("__first").isNull() | (stage_order(F.col("stage")) < F.col("__first"))).drop("__first")


def pending_work(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned stages without a ledger row under the same fingerprint."""
    return plan.join(done, ["fingerprint", *CHUNK, "stage"], "left_anti")


def append_increment(increment: DataFrame, path: str, run_id: str) -> None:
    """Adds one run's rows to the ledger.  A run that is repeated under its id replaces what it wrote before."""
    increment.write.mode("overwrite").partitionBy("fingerprint").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached result where fingerprint and range (3 decimals) match; corrupt entries and forced requests miss.

    ``requests``: fingerprint, start_sec, end_sec, force; ``cache``: fingerprint, start_sec, end_sec, segments (JSON)."""
    ms = lambda c: F.rint(F.col(c) * 1000).cast("long")
    usable = cache.filter(F.from_json("segments", "array<string>").isNotNull())
    stored = usable.groupBy("fingerprint", ms("start_sec").alias("__s"), ms("end_sec").alias("__e")).agg(F.max("segments").alias("cached"))
    r = requests.withColumns({"__s": ms("start_sec"), "__e": ms("end_sec")})
    hit = r.join(stored, ["fingerprint", "__s", "__e"], "left")
    return hit.withColumn("cached", F.when(~F.col("force"), F.col("cached"))).withColumn("hit", F.col("cached").isNotNull()).drop("__s", "__e")


def cache_validity(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Per chunk whether every expected frame file is there; one missing file sends the whole chunk back."""
    seen = listing.select("path").distinct().withColumn("__there", F.lit(True))
    return expected.join(seen, "path", "left").groupBy(*CHUNK).agg(
        F.count("*").alias("frames"), F.count_if(F.col("__there").isNull()).alias("missing"),
        F.bool_and(F.col("__there").isNotNull()).alias("valid"))


def plan_guard(plans: DataFrame, current: DataFrame) -> DataFrame:
    """Stored plans that carry the current fingerprint of their video."""
    return plans.join(current.select(KEY, "fingerprint"), [KEY, "fingerprint"], "left_semi")


def source_resolution(items: DataFrame, videos: DataFrame, scripts: DataFrame) -> DataFrame:
    """What each item lacks (``items``: item_id, url, force; ``videos``: item_id; ``scripts``: item_id, script_url).

    A stored script counts only if it belongs to the same URL."""
    v = videos.select("item_id").distinct().withColumn("__video", F.lit(True))
    s = scripts.select("item_id", F.col("script_url").alias("url")).distinct().withColumn("__script", F.lit(True))
    j = items.join(v, "item_id", "left").join(s, ["item_id", "url"], "left")
    have_video = F.col("__video").isNotNull() & ~F.col("force")
    have_script = F.col("__script").isNotNull() & ~F.col("force")
    action = F.when(have_video & have_script, "reuse").when(have_video, "fetch script").when(have_script, "fetch video").otherwise("fetch both")
    return j.select("item_id", "url", have_video.alias("have_video"), have_script.alias("have_script"), action.alias("action"))
