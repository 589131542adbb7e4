"""Thresholds and weights of resolution and alignment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    min_score: float = 0.40
    local_min_score: float = 0.35
    high_confidence: float = 0.75
    high_margin: float = 0.10
    medium_confidence: float = 0.60
    medium_margin: float = 0.05
    title_hard_floor: float = 0.30
    strong_alignment: float = 0.50
    weak_alignment: float = 0.30
    contradiction_score: float = 0.15
    cache_ttl_seconds: int = 30 * 24 * 3600


@dataclass(frozen=True)
class Weights:
    title: float = 0.45
    author: float = 0.30
    year: float = 0.15
    venue: float = 0.10


THRESHOLDS, WEIGHTS = Thresholds(), Weights()
