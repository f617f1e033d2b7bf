"""Voice catalogue, tone prosody and their choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import clamp
from .text import TONE_PROSODY

# Language, gender and voice name, in catalogue order.
VOICES = (
    ("vi", "Nữ", "vi-VN-HoaiMyNeural"),
    ("vi", "Nam", "vi-VN-NamMinhNeural"),
    ("en", "Nữ", "en-US-AriaNeural"),
    ("en", "Nữ", "en-US-JennyNeural"),
    ("en", "Nam", "en-US-GuyNeural"),
    ("en", "Nam", "en-US-DavisNeural"),
    ("en", "Nam", "en-US-ChristopherNeural"),
    ("en", "Nữ", "en-GB-SoniaNeural"),
    ("en", "Nam", "en-GB-RyanNeural"),
    ("en", "Nữ", "en-AU-NatashaNeural"),
    ("en", "Nam", "en-AU-WilliamNeural"),
    ("en", "Nữ", "en-IN-NeerjaNeural"),
)


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def pick_voice(language: Column, gender: Column, current: Column) -> tuple[Column, Column]:
    """(gender, voice): the asked gender if the language has it, else the last in sort order; the current voice if it
    belongs to that choice, else the first of it.  Null for an unknown language."""
    options: dict[str, list[str]] = {}
    fallback: dict[str, str] = {}
    for lang, g, voice in VOICES:
        options.setdefault(f"{lang}|{g}", []).append(voice)
        fallback[lang] = max(fallback.get(lang, g), g)
    by_choice = _lookup({k: F.array(*map(F.lit, v)) for k, v in options.items()})
    asked = F.concat_ws("|", language, gender)
    chosen = F.when(by_choice[asked].isNotNull() & gender.isNotNull(), gender).otherwise(
        _lookup({k: F.lit(v) for k, v in fallback.items()})[language])
    voices = by_choice[F.concat_ws("|", language, chosen)]
    keep = F.coalesce(F.array_contains(voices, F.coalesce(current, F.lit(""))), F.lit(False))
    return chosen, F.when(keep, current).otherwise(voices[0])


def prosody(tone: Column) -> tuple[Column, Column, Column]:
    return tuple(_lookup({t: F.lit(p[i]) for t, p in TONE_PROSODY.items()})[tone] for i in range(3))


def rate_factor(rate: Column) -> Column:
    """'+10%' becomes 1.1."""
    return F.lit(1.0) + F.regexp_replace(F.trim(rate), "%+$", "").cast("double") / 100.0


def engine_speed(rate: Column) -> Column:
    """Factor for engines that take one: two decimals, within [0.7, 1.2]."""
    return clamp(F.rint(rate_factor(rate) * 100) / 100.0, 0.7, 1.2)
