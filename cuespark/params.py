"""Parameters of the operators, grouped by the stage they belong to, with the limits they must respect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SilenceParams:
    """Levels in dBFS unless the samples are in another unit; the threshold is in theirs."""

    threshold: float = -30.0
    min_sec: float = 0.6

    def __post_init__(self) -> None:
        if self.min_sec < 0:
            raise ValueError("min_sec may not be negative")


@dataclass(frozen=True)
class ChunkParams:
    target_sec: float = 240.0
    tolerance_sec: float = 45.0
    min_chunk_sec: float = 60.0

    def __post_init__(self) -> None:
        if self.target_sec <= 0 or self.min_chunk_sec <= 0 or self.tolerance_sec < 0:
            raise ValueError("chunk parameters must be positive")
        if self.min_chunk_sec > self.target_sec:
            raise ValueError("min_chunk_sec may not exceed target_sec")


@dataclass(frozen=True)
class WindowParams:
    interval_sec: float = 2.5
    min_scene_sec: float = 1.5
    max_scene_sec: float = 6.0
    max_frames: int = 400
    max_frames_per_window: int = 2
    scene_threshold: float = 0.35

    def __post_init__(self) -> None:
        if self.interval_sec <= 0 or self.max_frames < 1 or self.max_frames_per_window < 1:
            raise ValueError("sampling parameters must be positive")
        if self.min_scene_sec > self.max_scene_sec:
            raise ValueError("min_scene_sec may not exceed max_scene_sec")


#: Words a second that a voice of a language speaks at ease.
SPEAKING_RATE = {"vi": 3.2, "en": 2.5}


@dataclass(frozen=True)
class ScriptParams:
    words_per_sec: float = SPEAKING_RATE["vi"]
    wps_tolerance: float = 1.15
    min_segment_sec: float = 1.0
    creativity: float = 0.3
    language: str = "vi"

    def __post_init__(self) -> None:
        if self.words_per_sec <= 0 or self.wps_tolerance < 1.0 or self.min_segment_sec <= 0:
            raise ValueError("script parameters out of range")
        if not 0.0 <= self.creativity <= 1.0:
            raise ValueError("creativity must lie in [0, 1]")


@dataclass(frozen=True)
class FitParams:
    max_speedup: float = 1.25
    allow_retime: bool = False
    slack_sec: float = 0.02
    min_target_sec: float = 0.3

    def __post_init__(self) -> None:
        if self.max_speedup < 1.0:
            raise ValueError("max_speedup must be at least 1")


@dataclass(frozen=True)
class PauseParams:
    min_pause_sec: float = 0.3
    max_pause_sec: float = 1.2
    max_advance_sec: float = 0.0
    seed: int = 7

    def __post_init__(self) -> None:
        if not 0 <= self.min_pause_sec <= self.max_pause_sec:
            raise ValueError("need 0 <= min_pause_sec <= max_pause_sec")
        if not 0 <= self.max_advance_sec <= 5:
            raise ValueError("max_advance_sec must lie in [0, 5]")

    @property
    def max_advance_ms(self) -> int:
        return int(round(self.max_advance_sec * 1000))


@dataclass(frozen=True)
class MixParams:
    duck_ratio: float = 0.15
    ramp_ms: int = 80
    merge_gap_ms: int = 300
    voice_gain_db: float = 0.0
    silent_dbfs: float = -65.0
    full_scale: float = 32767.0
    limit_share: float = 0.97

    def __post_init__(self) -> None:
        if not 0.0 <= self.duck_ratio <= 1.0 or self.ramp_ms < 0:
            raise ValueError("mix parameters out of range")


@dataclass(frozen=True)
class HighlightParams:
    budget_ratio: float = 0.4
    touch_slack_sec: float = 1e-3

    def __post_init__(self) -> None:
        if not 0.0 < self.budget_ratio <= 1.0 or self.touch_slack_sec < 0:
            raise ValueError("budget_ratio must lie in (0, 1]")
