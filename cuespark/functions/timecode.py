"""Time codes: text to seconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
TIME_CODE = rf"^{WS}*{NUMBER}{WS}*(?::{WS}*{NUMBER}{WS}*){{0,2}}$"


def parse_timestamp(c: Column) -> Column:
    """Seconds from ``[[H:]M:]S`` (comma or point); null for anything invalid or negative."""
    text = F.translate(c, ",", ".")
    parts = F.split(F.when(text.rlike(TIME_CODE), F.regexp_replace(text, WS + "+", "")), ":")
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"), lambda t: F.when(t >= 0, t))


def millis(sec: Column) -> Column:
    """Whole milliseconds, half to even."""
    return F.rint(sec * 1000).cast("long")


def _clock(sec: Column, separator: str) -> Column:
    ms = F.greatest(millis(sec), F.lit(0).cast("long"))
    return F.format_string(
        f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms % 3600000 / 60000).cast("long"),
        F.floor(ms % 60000 / 1000).cast("long"), (ms % 1000).cast("long"),
    )


def format_timestamp(sec: Column) -> Column:
    return _clock(sec, ".")


def srt_timestamp(sec: Column) -> Column:
    return _clock(sec, ",")
