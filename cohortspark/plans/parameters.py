"""The numbers and lists of a study design."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from cohortspark import constants as k


@dataclass(frozen=True)
class StudyParameters:
    """Every limit of a study; the defaults are the design's own values."""

    lower_limit: float = k.LOWER_LIMIT
    upper_limit: float = k.UPPER_LIMIT
    min_age: int = k.MIN_AGE
    baseline_days: int = k.BASELINE_DAYS
    surgery_patterns: Sequence[str] = k.SURGERY_PATTERNS
    procedure_codes: Sequence[int] = k.RADIOIODINE_CODES
    exact: Sequence[str] = ("gender_concept_id",)
    controls: int = k.CONTROLS_PER_CASE
    age_band: int = k.AGE_BAND
    entry_band: int = k.ENTRY_BAND
    lookback_days: int = k.LOOKBACK_DAYS
    exposure_mode: str = "endpoint"
    recency_bins: Sequence[int] = k.RECENCY_BINS
    span_gap: int = k.SPAN_GAP
    era_gap: int = k.ERA_GAP
    era_compare: str = "previous_row"
    era_block_days: int | None = None
    follow_up_days: int = k.FOLLOW_UP_DAYS
    drug_classes: Sequence[str] = k.DRUG_CLASSES
    age_bands: Sequence[tuple[int, int]] = k.AGE_BANDS
    gender_code: int = k.MALE
    score_weights: Mapping[str, int] = field(default_factory=lambda: dict(k.SCORE_WEIGHTS))
    score_cuts: Sequence[int] = k.SCORE_CUTS
    hormones: Mapping[str, Sequence[int]] = field(default_factory=lambda: dict(k.HORMONES))
    string_min: bool = False
    chapter_mode: str = "reference"
