"""Constants that define the semantics, and the policy switches."""

from __future__ import annotations

import os
from dataclasses import dataclass

NONE = "NONE"
DONE = "완료"
ON_HOLD = "보류"


@dataclass(frozen=True)
class Policy:
    """Defaults give the published behaviour; ``from_env`` reads the run-time overrides."""

    year_min: int = 2015
    year_max: int = 2035
    flip_ratio: float = 6.0
    # How likely a year is on a label; other years get ``prior_floor``. Fixed values.
    year_prior: tuple[tuple[int, float], ...] = (
        (2019, 0.0094), (2020, 0.0499), (2021, 0.3900), (2022, 0.2051), (2023, 0.0526), (2024, 0.0067), (2025, 0.0513), (2026, 0.1849), (2027, 0.0418), (2028, 0.0081),
    )
    prior_floor: float = 0.002
    distribution_date_counts: bool = True
    relative_as_none: bool = False
    compact_window: int = 30
    kind_window: int = 20
    until_reach: int = 5
    month_day_window: int = 40
    context: int = 25
    end_hint_reach: int = 60
    longest_period_digits: int = 6

    @classmethod
    def from_env(cls) -> "Policy":
        return cls(flip_ratio=float(os.environ.get("LABELDATES_FLIP_RATIO", "6.0")))


@dataclass(frozen=True)
class DetectorConfig:
    size: int = 960
    confidence: float = 0.25
    iou: float = 0.45
    classes: tuple[str, ...] = ("date", "due", "code", "full")
    pad: float = 0.45
    tight_pad: float = 0.10
    least_pad_px: int = 12
    longest_crop_side: int = 4000
    upscale_height: int = 100
    full_image_side: int = 1600
    line_tolerance: float = 0.6


@dataclass(frozen=True)
class ReaderConfig:
    """Parameters that a text recognizer is set up with; handed to the provider as they are."""

    text_score: float = 0.5
    detection_limit_side: int = 736
    detection_limit_type: str = "min"
    detection_threshold: float = 0.3
    box_threshold: float = 0.5
    unclip_ratio: float = 2.2
    dilation: bool = True
    angle_threshold: float = 0.9
    recognition_shape: tuple[int, int, int] = (3, 48, 320)


@dataclass(frozen=True)
class RunConfig:
    """A batch run: where to read and write, and how long it may take."""

    input_dir: str = "data/images"
    output_path: str = "submission.csv"
    budget_s: float = 2300.0
    limit_s: float = 2500.0
    workers: int = 3
    threads: int = 1

    @classmethod
    def from_env(cls) -> "RunConfig":
        e = os.environ
        return cls(
            input_dir=e.get("LABELDATES_INPUT_DIR", cls.input_dir), output_path=e.get("LABELDATES_OUTPUT_PATH", cls.output_path), budget_s=float(e.get("LABELDATES_BUDGET_SEC", cls.budget_s)),
            workers=int(e.get("LABELDATES_WORKERS", cls.workers)), threads=int(e.get("LABELDATES_WORKER_THREADS", cls.threads)),
        )


DEFAULT = Policy()
