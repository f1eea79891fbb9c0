"""Imports the query modules so that the registry is complete."""

from __future__ import annotations

from . import analysis, comparison, dataset, metrics, runs, waveforms  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
