"""Every threshold of the pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    min_narrative: int = 30
    us_only: bool = True
    first_year: int = 1900
    last_year: int = 2026
    id_prefix: int = 200
    id_length: int = 16
    schema_overlap: int = 4
    vocab_first_year: int = 1940
    vocab_bin: int = 5
    vocab_min_total: float = 1.0
    night_min_reports: int = 3
    night_distance: float = 0.35
    night_min_size: int = 3
    flap_first_year: int = 1990
    flap_ratio: float = 3.0
    flap_min_reports: int = 8
    flap_gap_days: int = 14
    flap_state_gate: int = 20
    flap_week_gate: int = 3
    flap_floor: float = 0.5
    weeks_per_year: int = 52
    signature_min_reports: int = 3
    signature_phrases: int = 20
    signature_features: int = 8000
    class_features: int = 10_000
    class_min_df: int = 2
    window_days: int = 7
    dense_days: int = 1
    dense_reports: int = 3


DEFAULT = Params()
