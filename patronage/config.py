"""Settings of the engine. One frozen dataclass, every operator takes it as an argument."""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from patronage import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    seed: int = 42

    # cleaning and validation
    admin_code_pattern: str = fv.ADMIN_CODE_PATTERN
    description_typos: dict[str, str] = field(default_factory=dict)
    iqr_multiplier: float = 3.0
    entry_error_abs_quantity: float = 50000
    max_null_rate: dict[str, float] = field(default_factory=lambda: dict(fv.MAX_NULL_RATE))
    expected_date_min: datetime = datetime(2009, 12, 1)
    expected_date_max: datetime = datetime(2011, 12, 9, 23, 59, 59)
    max_nonpositive_price_rate: float = 0.02

    # features and labels
    churn_horizon_days: int = 90
    clv_horizon_days: int = 90
    trend_window_bins: int = 12
    trend_bin_days: int = 30
    discount_threshold: float = 0.10
    top_countries: int = 5
    vif_threshold: float = 10.0
    vif_protected: tuple[str, ...] = ("recency_days", "frequency")
    category_words: dict[str, list[str]] = field(default_factory=lambda: dict(fv.CATEGORY_WORDS))
    sequence_max_len: int = 20

    # splits, search, thresholds
    split_train: float = 0.70
    split_val: float = 0.15
    min_recall: float = 0.70
    imbalance: str = "class_weight"  # or "smote": synthetic rows in the training part of every fit
    cv_folds: int = 5
    search_iterations: int = 8

    # segmentation, explanation, serving
    k_min: int = 3
    k_max: int = 8
    kmeans_restarts: int = 10
    anomaly_percentile: float = 0.99
    background_size: int = 500
    local_samples: int = 1500
    local_features: int = 10
    top_reasons: int = 3
    risk_medium_ratio: float = 0.6

    @property
    def categories(self) -> list[str]:
        return list(self.category_words)

    @property
    def affinity_columns(self) -> list[str]:
        return [f"affinity_{c}" for c in self.category_words]

    @property
    def feature_columns(self) -> list[str]:
        return fv.BASE_FEATURES + self.affinity_columns

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
