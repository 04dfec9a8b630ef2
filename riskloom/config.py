"""Settings with their defaults and checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Thresholds:
    moderate: float = 3.0
    high: float = 6.0
    critical: float = 9.0


@dataclass(frozen=True)
class Weights:
    cc: float = 1.0
    nd: float = 0.8
    fo: float = 0.6
    ns: float = 0.7


@dataclass(frozen=True)
class Scoring:
    churn: float = 0.5
    touch: float = 0.3
    recency: float = 0.2
    fan_in: float = 0.4
    scc: float = 0.3
    depth: float = 0.1
    neighbor_churn: float = 0.2


@dataclass(frozen=True)
class Warnings:
    watch_min: float = 2.5
    watch_max: float = 3.0
    attention_min: float = 5.5
    attention_max: float = 6.0
    rapid_growth_percent: float = 50.0


@dataclass(frozen=True)
class Patterns:
    complex_branching_cc: int = 10
    complex_branching_nd: int = 4
    deeply_nested_nd: int = 5
    exit_heavy_ns: int = 5
    god_function_loc: int = 60
    god_function_fo: int = 10
    long_function_loc: int = 80
    churn_magnet_churn: int = 200
    churn_magnet_cc: int = 8
    cyclic_hub_scc: int = 2
    cyclic_hub_fan_in: int = 6
    hub_function_fan_in: int = 10
    hub_function_cc: int = 8
    middle_man_fan_in: int = 8
    middle_man_fo: int = 8
    middle_man_cc_max: int = 4
    neighbor_risk_churn: int = 400
    neighbor_risk_fo: int = 8
    shotgun_target_fan_in: int = 8
    shotgun_target_churn: int = 150
    stale_complex_cc: int = 10
    stale_complex_loc: int = 60
    stale_complex_days: int = 180


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = field(default_factory=Thresholds)
    weights: Weights = field(default_factory=Weights)
    scoring: Scoring = field(default_factory=Scoring)
    warning_thresholds: Warnings = field(default_factory=Warnings)
    patterns: Patterns = field(default_factory=Patterns)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    min_lrs: float | None = None
    top: int | None = None
    co_change_window_days: int = 90
    co_change_min_count: int = 3
    driver_threshold_percentile: int = 75
    betweenness_exact_threshold: int = 2000
    betweenness_approx_k: int = 256
    callgraph_skip_above: int | None = None
    per_function_touches: bool = False
    hybrid_touch_threshold: int | None = None
    critical_introduction: str = "block"
    excessive_risk_regression: str = "block"
    policy_reasons: dict = field(default_factory=dict)

    def validate(self) -> Config:
        """self, or ValueError with the first thing that is wrong."""

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        t, w = self.thresholds, self.warning_thresholds
        need(0 < t.moderate < t.high < t.critical, "thresholds must be positive and rise")
        for group in (self.weights, self.scoring):
            for f in fields(group):
                need(0 <= getattr(group, f.name) <= 10, f"{f.name} must be from 0 to 10")
        for f in fields(w):
            need(getattr(w, f.name) > 0, f"{f.name} must be positive")
        need(w.watch_min < w.watch_max and w.attention_min < w.attention_max, "a warning range's minimum must be below its maximum")
        for f in fields(self.patterns):
            need(getattr(self.patterns, f.name) >= 1, f"patterns.{f.name} must be at least 1")
        for name in ("critical_introduction", "excessive_risk_regression"):
            mode = getattr(self, name)
            need(mode in ("block", "warn", "off"), f"{name} must be block, warn or off")
            need(mode == "block" or bool(self.policy_reasons.get(name)), f"{name} needs a reason to be less than block")
        need(self.min_lrs is None or self.min_lrs >= 0, "min_lrs must not be negative")
        need(self.top is None or self.top >= 1, "top must be at least 1")
        need(self.co_change_window_days >= 1 and self.co_change_min_count >= 1, "co-change settings must be at least 1")
        need(1 <= self.driver_threshold_percentile <= 99, "driver_threshold_percentile must be from 1 to 99")
        need(self.betweenness_approx_k >= 1, "betweenness_approx_k must be at least 1")
        return self

    @classmethod
    def from_dict(cls, raw: dict) -> Config:
        """Settings from parsed JSON; unknown keys are errors."""
        kinds = {"thresholds": Thresholds, "weights": Weights, "scoring": Scoring, "warning_thresholds": Warnings, "patterns": Patterns}
        names = {f.name for f in fields(cls)}
        made = {}
        for key, value in raw.items():
            if key not in names:
                raise ValueError(f"unknown setting: {key}")
            if key in kinds:
                inner = {f.name for f in fields(kinds[key])}
                if extra := set(value) - inner:
                    raise ValueError(f"unknown setting: {key}.{sorted(extra)[0]}")
                value = kinds[key](**value)
            elif isinstance(value, list):
                value = tuple(value)
            made[key] = value
        return cls(**made).validate()

    @classmethod
    def load(cls, root: str, names: tuple[str, ...] = (".riskloomrc.json", "riskloom.config.json"), package_key: str = "riskloom") -> Config:
        """The first of the named files under root, else that key of package.json, else the defaults."""
        for name in names:
            if (path := Path(root, name)).exists():
                return cls.from_dict(json.loads(path.read_text()))
        if (path := Path(root, "package.json")).exists() and (found := json.loads(path.read_text()).get(package_key)) is not None:
            return cls.from_dict(found)
        return cls()
