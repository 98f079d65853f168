"""Metric signals from running baselines, one fold a series.

Each sample is judged against the state before it: thresholds, deviation from a running mean, drift of a
fast against a slow average, unless the same deviation came at this time of day on the days before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import MIN_DELTAS, min_delta
from tidemark.functions.templates import path_glob
from tidemark.operators import caps
from tidemark.operators.folds import Resume, keyed_fold, micros

DAY = 86_400_000_000
ZSCORE, DRIFT, THRESHOLD = "metric.zscore", "metric.trend_drift", "metric.threshold"
SAMPLE = "event_id long, ts_us long, value double, n long, mean double, variance double, fast double, slow double, z double, drift double, kinds array<string>, scores array<double>, recurring_days int"


@dataclass(frozen=True)
class MetricConfig:
    warmup: int = 30
    alpha: float = 0.05
    z_threshold: float = 3.0
    fast: float = 0.3
    slow: float = 0.05
    trend: float = 0.5
    daily: bool = True
    tolerance_us: int = 300_000_000
    days: int = 3
    remembered: int = 32
    ttl_us: int = 7 * DAY
    max_series: int = 0  # remembered at most, the least recently seen go; 0: no limit


@dataclass
class Series:
    """The state of one series; non-finite samples are left out, as they would spoil every later average."""

    config: MetricConfig = MetricConfig()
    n: int = 0
    mean: float = 0.0
    variance: float = 0.0
    fast: float = 0.0
    slow: float = 0.0
    last_seen: int | None = None
    drifting: bool = False
    deviations: list[int] = field(default_factory=list)

    STATE: ClassVar[str] = "n long, mean double, variance double, fast double, slow double, last_seen long, drifting boolean, deviations array<long>"

    def state(self) -> tuple:
        return self.n, self.mean, self.variance, self.fast, self.slow, self.last_seen, self.drifting, self.deviations

    def restore(self, state: dict) -> None:
        for name, value in state.items():
            setattr(self, name, list(value) if name == "deviations" else value)

    def step(self, event_id, ts: int, value: float | None, least: float, high: float | None = None, low: float | None = None, ignored: bool = False, fresh: bool = False) -> Iterator[tuple]:
        if value is None or not math.isfinite(value):
            return
        c = self.config
        if fresh or self.last_seen is not None and ts - self.last_seen > c.ttl_us:
            self.__init__(c)
        self.last_seen = ts
        before = (self.n, self.mean, self.variance, self.fast, self.slow)
        found: list[tuple[str, float]] = []
        z = drift = None
        days = 0
        if not ignored:
            found += [(THRESHOLD, 0.9)] * ((high is not None and value > high) + (low is not None and value < low))
            if self.n >= c.warmup:
                z, drift, own = self._statistical(value, least)
                if own:
                    days = self._days_before(ts)
                    if not self.deviations or abs(ts - self.deviations[-1]) > c.tolerance_us:
                        self.deviations = [*self.deviations, ts][-c.remembered :]
                    if not (c.daily and days >= c.days - 1):
                        found += own
        self._learn(value)
        yield event_id, ts, value, *before, z, drift, [k for k, _ in found], [s for _, s in found], days if c.daily else 0

    def finish(self) -> Iterator[tuple]:
        return iter(())

    def _statistical(self, value: float, least: float) -> tuple[float | None, float, list[tuple[str, float]]]:
        c, out, z = self.config, [], None
        sd = math.sqrt(self.variance)
        if sd > 0:
            z = (value - self.mean) / sd
            if abs(value - self.mean) >= least and abs(z) >= c.z_threshold:
                out.append((ZSCORE, min(0.95, 0.5 + abs(z) / 10)))
        apart = abs(self.fast - self.slow)
        drift = apart / max(abs(self.slow), 1e-9)
        drifts = drift >= c.trend and apart >= least
        if drifts and not self.drifting:
            out.append((DRIFT, 0.6))
        self.drifting = drifts
        return z, drift, out

    def _days_before(self, ts: int) -> int:
        """Days in a row, from yesterday back, with a deviation at about this time."""
        days = 0
        while days < self.config.days - 1 and any(abs(d - (ts - DAY * (days + 1))) <= self.config.tolerance_us for d in self.deviations):
            days += 1
        return days

    def _learn(self, value: float) -> None:
        c = self.config
        if not self.n:
            self.mean = self.fast = self.slow = value
        else:
            delta = value - self.mean
            self.mean += c.alpha * delta
            self.variance = (1 - c.alpha) * (self.variance + c.alpha * delta * delta)
            self.fast += c.fast * (value - self.fast)
            self.slow += c.slow * (value - self.slow)
        self.n += 1


def _sample(samples: DataFrame) -> str:
    return SAMPLE.replace("event_id long", f"event_id {samples.schema['event_id'].dataType.simpleString()}")


def judge(
    samples: DataFrame,
    config: MetricConfig = MetricConfig(),
    rules: dict[str, tuple[float | None, float | None]] | None = None,
    ignored: list[str] | None = None,
    deltas: dict[str, float] = MIN_DELTAS,
    keys: tuple[str, ...] = ("series",),
    resume: Resume | None = None,
) -> DataFrame:
    """``samples`` (series, metric, event_id, ts, value): every sample with the state before it and the signals it gives.

    ``keys``: columns that name a series, all of which come along; ``resume``: goes on where an earlier run ended.

    ``rules``: (highest, lowest) allowed value by metric; ``ignored``: globs of metrics or series that learn but never signal.
    """
    rows = prepared(samples, rules, ignored, deltas, keys)
    if config.max_series <= 0:
        return keyed_fold(rows, keys, ["ts", "event_id"], STEP, lambda: Series(config), _sample(samples), resume)
    rows = _remembered(rows, keys, config.max_series, resume)
    return keyed_fold(rows, keys, ["ts", "event_id"], [*STEP, "fresh"], lambda: Series(config), _sample(samples), resume)


def _remembered(rows: DataFrame, keys: tuple[str, ...], most: int, resume: Resume | None) -> DataFrame:
    """``rows`` that count, with ``fresh`` where the series has been forgotten; what an earlier run knew was last seen when it says."""
    rows = rows.filter(F.abs("value") < float("inf"))  # neither null nor, since it sorts above infinity, NaN
    if resume is None or resume.before is None:
        return caps.marked(rows, keys, ["ts", "event_id"], most)
    saved = rows.sparkSession.read.parquet(resume.before).select(*keys, F.col("last_seen").alias("ts"), F.lit(True).alias("_saved"))
    both = rows.withColumn("_saved", F.lit(False)).unionByName(saved, allowMissingColumns=True)
    return caps.marked(both, keys, ["ts", "event_id"], most).filter("not _saved").drop("_saved")


#: What a series is stepped with.
STEP = ["event_id", "ts", "value", "least", "high", "low", "ignored"]


def prepared(
    samples: DataFrame, rules: dict[str, tuple[float | None, float | None]] | None = None, ignored: list[str] | None = None,
    deltas: dict[str, float] = MIN_DELTAS, keys: tuple[str, ...] = ("series",),
) -> DataFrame:
    """``keys`` and the columns of STEP, in batch and streams."""
    limit = lambda k: F.coalesce(*[F.when(F.col("metric") == m, F.lit(r[k]).cast("double")) for m, r in (rules or {}).items()], F.lit(None).cast("double"))
    silent = F.lit(False)
    for glob in ignored or ():
        for c in ("metric", "series"):
            silent = silent | F.coalesce(path_glob(F.col(c), glob), F.lit(False))
            silent = silent | (F.col(c) == glob)
    return samples.select(
        *keys, "event_id", micros("ts"), "value", min_delta(F.col("metric"), deltas).alias("least"), limit(0).alias("high"), limit(1).alias("low"), silent.alias("ignored")
    )


def signals(judged: DataFrame) -> DataFrame:
    """One row for each signal of ``judge``'s rows."""
    each = F.explode(F.arrays_zip(F.col("kinds").alias("kind"), F.col("scores").alias("score"))).alias("s")
    state = {f.split()[0] for f in SAMPLE.split(", ")}
    own = [c for c in judged.columns if c not in state] + ["event_id", "ts_us"]
    return judged.filter(F.size("kinds") > 0).select(*own, "value", "mean", "z", "recurring_days", each).select(
        *own, F.col("s.kind").alias("kind"), F.col("s.score").alias("score"), "value", "mean", "z", "recurring_days"
    )


class _Last(Series):
    """Only the state after the last sample."""

    def step(self, *row) -> Iterator[tuple]:
        for _ in Series.step(self, *row):
            pass
        return iter(())

    def finish(self) -> Iterator[tuple]:
        if self.n:
            yield self.n, self.mean, math.sqrt(self.variance), self.fast, self.n < self.config.warmup


def series_table(samples: DataFrame, config: MetricConfig = MetricConfig()) -> DataFrame:
    """(series, samples, mean, std_dev, recent, warmup) after all samples."""
    rows = samples.select("series", "event_id", micros("ts"), "value", F.lit(0.0).alias("least"))
    return keyed_fold(
        rows, ["series"], ["ts", "event_id"], ["event_id", "ts", "value", "least"], lambda: _Last(config), "samples long, mean double, std_dev double, recent double, warmup boolean"
    )
