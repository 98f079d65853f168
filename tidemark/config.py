"""Configuration: defaults, YAML with strict keys and ``${VAR}``, durations such as ``30s`` or ``168h``."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field
from typing import Any, get_type_hints

UNITS_S = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(value: str | float) -> float:
    """Seconds of a number, or of a text of numbers with units."""
    if isinstance(value, (int, float)):
        return float(value)
    parts = re.findall(r"([0-9.]+)(ns|us|µs|ms|s|m|h)", value)
    if value.strip() == "0":
        return 0.0
    if not parts or "".join(a + b for a, b in parts) != value.lstrip("+-"):
        raise ValueError(f"not a duration: {value!r}")
    return (-1 if value.startswith("-") else 1) * sum(float(n) * UNITS_S[u] for n, u in parts)


class Seconds(float):
    """A field that takes durations."""


@dataclass
class Mask:
    pattern: str = ""
    mask_with: str = ""


@dataclass
class Drain:
    depth: int = 4
    similarity_threshold: float = 0.4
    max_children: int = 100
    max_clusters: int = 2000
    max_tokens: int = 32
    parametrize_numeric_tokens: bool = True
    extra_delimiters: list[str] = field(default_factory=list)
    masking: list[Mask] = field(default_factory=list)


@dataclass
class LogDetection:
    enabled: bool = True
    learning_period: Seconds = Seconds(300)
    rare_threshold: int = 3
    rare_min_observations: int = 500
    rare_max_interval: Seconds = Seconds(3600)
    spike_bucket: Seconds = Seconds(60)
    spike_factor: float = 3.0
    spike_min_count: int = 10
    disappearance_factor: float = 3.0
    disappearance_min_count: int = 10
    disappearance_scan_interval: Seconds = Seconds(30)
    disappearance_min_silence: Seconds = Seconds(300)
    disappearance_scope: str = "heartbeat"
    disappearance_max_cv: float = 0.5
    min_template_literals: int = 8
    max_placeholder_ratio: float = 0.6
    seasonality: str = "hourly"
    seasonal_min_observations: int = 50
    max_templates: int = 2000
    markings: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)


@dataclass
class Logs:
    drain: Drain = field(default_factory=Drain)
    detection: LogDetection = field(default_factory=LogDetection)


@dataclass
class Threshold:
    metric: str = ""
    max: float | None = None
    min: float | None = None


@dataclass
class MetricDetection:
    enabled: bool = True
    warmup_samples: int = 30
    alpha: float = 0.05
    z_threshold: float = 3.0
    min_deltas: dict[str, float] = field(default_factory=lambda: {"*percent": 10.0})
    trend_fast_alpha: float = 0.3
    trend_slow_alpha: float = 0.05
    trend_threshold: float = 0.5
    max_series: int = 10_000
    seasonality: str = "daily"
    seasonal_tolerance: Seconds = Seconds(300)
    seasonal_days: int = 3
    series_ttl: Seconds = Seconds(168 * 3600)
    thresholds: list[Threshold] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)


@dataclass
class Metrics:
    detection: MetricDetection = field(default_factory=MetricDetection)


@dataclass
class Dampening:
    cooldown: Seconds = Seconds(3600)
    max_cooldown: Seconds = Seconds(12 * 3600)
    escalation: float = 0.1
    max_tracked: int = 20_000


@dataclass
class Correlation:
    window: Seconds = Seconds(30)
    context_before: int = 10
    context_after: int = 10
    clock: str = "wall"
    change_horizon: Seconds = Seconds(900)
    echo_window: Seconds = Seconds(600)


@dataclass
class Events:
    retention: Seconds = Seconds(15 * 24 * 3600)


@dataclass
class Config:
    max_log_length: int = 8192
    logs: Logs = field(default_factory=Logs)
    metrics: Metrics = field(default_factory=Metrics)
    dampening: Dampening = field(default_factory=Dampening)
    correlation: Correlation = field(default_factory=Correlation)
    events: Events = field(default_factory=Events)


#: What some fields may hold.
CHOICES = {
    "disappearance_scope": ("heartbeat", "all"),
    "logs.detection.seasonality": ("none", "hourly"),
    "metrics.detection.seasonality": ("none", "daily"),
    "clock": ("wall", "event"),
    "markings": ("symptomatic", "heartbeat", "normal", "ignore"),
}


def _filled(kind: Any, value: Any, path: str) -> Any:
    if dataclasses.is_dataclass(kind):
        hints = get_type_hints(kind)
        if unknown := set(value or {}) - set(hints):
            raise ValueError(f"unknown keys under {path or 'the top'}: {', '.join(sorted(unknown))}")
        return kind(**{k: _filled(hints[k], v, f"{path}.{k}".lstrip(".")) for k, v in (value or {}).items()})
    if kind is Seconds:
        value = duration(value)
        if value < 0:
            raise ValueError(f"{path} is negative")
        return value
    if kind == list[Mask] or kind == list[Threshold]:
        return [_filled(kind.__args__[0], v, path) for v in value or []]
    for name, choices in CHOICES.items():
        if path.endswith(name) and isinstance(value, str) and value not in choices:
            raise ValueError(f"{path} is {value!r}, not one of {', '.join(choices)}")
    if path.endswith(("markings", "patterns")) and set((value or {}).values()) - set(CHOICES["markings"]):
        raise ValueError(f"{path} has a marking that isn't one of {', '.join(CHOICES['markings'])}")
    if kind is int and isinstance(value, int) and value < 0 and not path.endswith("max_tokens"):
        raise ValueError(f"{path} is negative")
    return value


def load(text: str, environment: dict[str, str] | None = None) -> Config:
    """A configuration from YAML over the defaults."""
    import yaml

    own = os.environ if environment is None else environment
    tree = yaml.safe_load(re.sub(r"\$\{(\w+)\}", lambda m: own.get(m[1], ""), text)) or {}
    out = _filled(Config, tree, "")
    if out.logs.drain.depth < 3 or out.logs.drain.max_tokens == 1:
        raise ValueError("drain: depth is at least 3, max_tokens isn't 1")
    return out
