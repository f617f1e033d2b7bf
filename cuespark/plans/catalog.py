"""Imports every area so that the registry is complete."""

from . import detection, ingest, narration, production, scalars, script, streams, triage  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
