"""Parameters of the four plans, validated when they are made."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class TaggerConfig:
    outdir: str = "topic_hypergraph_output"
    top: int = 15


@dataclass(frozen=True)
class KeywordConfig:
    window_start: int
    window_end: int
    target_year: int
    top_keywords_per_paper: int = 5
    top_keywords_per_topic: int = 15
    min_df: int = 2
    max_features: int = 20_000
    ngrams: tuple[int, ...] = (1, 2, 3)
    drop_empty_keywords: bool = False
    outdir: str = "keyword_topic_transparency_output"

    def __post_init__(self) -> None:
        _need(self.window_end >= self.window_start, "window_end must be >= window_start")
        _need(self.target_year > self.window_end, "target_year must be after window_end")
        _need(bool(self.ngrams) and min(self.ngrams) >= 1, "at least one n-gram size is needed")

    @property
    def warns(self) -> bool:
        """The target isn't the year after the window."""
        return self.target_year != self.window_end + 1


#: The terms of a full trend score; the command line ranks by all of them.
TREND_MODELS = ("linear", "exponential", "logistic")


@dataclass(frozen=True)
class ItemsetConfig:
    min_year: int = 2015
    max_year: int = 2025
    forecast_year: int = 2026
    df_min_count: int = 3
    df_max_frac: float = 0.25
    minsup_frac: float = 0.01
    min_count: int = 2
    min_lift: float = 1.5
    baseline: Literal["drift", "ar1", "mean"] = "drift"
    window: int = 5
    top_m: int = 5
    eval_k: int = 50
    trend_models: tuple[str, ...] = ("linear",)
    max_items: int = 64
    outdir: str = "keyword_itemset_output"

    def __post_init__(self) -> None:
        _need(self.baseline in ("drift", "ar1", "mean"), "baseline is drift, ar1 or mean")
        _need(self.window >= 1 and self.max_year >= self.min_year, "an empty range of years")
        _need(set(self.trend_models) <= set(TREND_MODELS), "unknown trend model")


@dataclass(frozen=True)
class ForecastConfig:
    predict_year: int
    window_size: int = 5
    target_mode: Literal["count", "binary"] = "count"
    structure: Literal["identity", "incidence"] = "identity"
    hidden_dim: int = 64
    dropout: float = 0.15
    epochs: int = 200
    lr: float = 1e-3
    weight_decay: float = 1e-4
    seed: int = 42
    outdir: str = "temporal_hypergraph_output"

    def __post_init__(self) -> None:
        _need(self.target_mode in ("count", "binary"), "target_mode is count or binary")
        _need(self.structure in ("identity", "incidence"), "structure is identity or incidence")
        _need(self.window_size >= 1, "window_size must be positive")
