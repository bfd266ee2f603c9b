"""Settings of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Limits and thresholds; every operator takes what it needs of them as parameters."""

    top_k: int = 6
    min_score: float = 10.0
    min_query_coverage: float = 0.15
    minimum_anchors: int = 2
    chunk_size: int = 6000
    chunk_overlap: int = 500
    max_chars: int = 120_000
    max_json_chars: int = 500_000
    quality_threshold: float = 65.0
    reuse_similarity: float = 0.92
    match_similarity: float = 0.5
    near_duplicate: float = 0.9
    max_cases: int = 3
    max_steps: int = 12
    max_seconds: int = 900
    max_tool_calls: int = 20
    max_tokens: int = 50_000


DEFAULTS = Settings()
