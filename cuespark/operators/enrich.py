"""Enrichment by pluggable engines, and the SQL form of the payload reader."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .responses import read_records

Engine = Callable[[str], float]


def _spoken_length(text: str) -> float:
    """Offline stand-in for a speech engine: 280 ms per word, 120 ms before and 150 ms after."""
    if "\x00" in text:
        raise ValueError("text holds a null character")
    return (280 * max(1, len(text.split())) + 270) / 1000.0


ENGINES: dict[str, Engine] = {"offline_speech": _spoken_length}


def engine(name: str) -> Engine:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(sorted(ENGINES))}")
    return ENGINES[name]


def enrich_with_engine(requests: DataFrame, name: str, cache: DataFrame | None = None, parallelism: int | None = None) -> DataFrame:
    """Result per distinct content key (``requests``: content_key, spoken): duration, status and error.

    Keys found in ``cache`` are not sent again.  A failing item becomes a row with status failed.  The number of
    partitions bounds how many calls run at once."""
    call = engine(name)
    todo = requests.groupBy("content_key").agg(F.min("spoken").alias("spoken"))
    if cache is not None:
        todo = todo.join(cache.filter(F.col("status") == "ok").select("content_key"), "content_key", "left_anti")
    if parallelism:
        todo = todo.repartition(parallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["content_key"], pdf["spoken"]):
                try:
                    rows.append((key, call(text), "ok", None) if text else (key, None, "skipped", None))
                except Exception as e:  # noqa: BLE001  (one bad item must not fail the batch)
                    rows.append((key, None, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["content_key", "duration_sec", "status", "error"])

    return todo.mapInPandas(run, "content_key string, duration_sec double, status string, error string")


class PayloadRows:
    """Table function: one row per record found in a response text."""

    def eval(self, text: str):
        records, method, partial = read_records(text)
        for i, record in enumerate(records or []):
            yield i, method, partial, json.dumps(record, ensure_ascii=False)


def register_payload(spark: SparkSession, name: str = "payload") -> None:
    """Makes ``SELECT ... FROM t, LATERAL payload(t.text)`` available."""
    fn = F.udtf(PayloadRows, returnType="record_no int, method string, partial boolean, record string")
    spark.udtf.register(name, fn)
