"""Run parameters.  Durations are seconds; everything else is a plain number."""

from __future__ import annotations

from dataclasses import dataclass, replace

NS = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    # windows
    window_seconds: int = 30
    sequence_length: int = 20
    score_interval_seconds: int = 30
    # fitting
    validation_split: float = 0.2
    n_std: float = 2.0
    target_fpr: float = 0.05
    # detectors: directions of the window detector (0: the mean alone) and power steps to find each;
    # whether the sequence detector predicts by the slope of each feature instead of persistence
    latent_dims: int = 0
    power_steps: int = 40
    predict_steps: bool = False
    # scoring
    sequence_weight: float = 0.6
    window_weight: float = 0.4
    medium: float = 40.0
    high: float = 70.0
    critical: float = 90.0
    # alert funnel
    dedup_seconds: int = 300
    rate_window_seconds: int = 60
    max_alerts_per_window: int = 10
    # storage
    retention_days: int = 30
    # physical layout: how many rows of one key may meet in one task, and the
    # length of a time chunk used wherever the rows of one key have to be put in order
    rows_per_task: int = 2_000_000
    order_chunk_seconds: int = 60

    @property
    def window_ns(self) -> int:
        return self.window_seconds * NS

    @property
    def stride_ns(self) -> int:
        return max(self.window_ns // 2, 1)

    @property
    def tick_ns(self) -> int:
        return self.score_interval_seconds * NS

    @property
    def order_chunk_ns(self) -> int:
        return self.order_chunk_seconds * NS

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)
