"""Log signals, one fold a source: new, rare, bursting, symptomatic and missing templates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.templates import best_marking, informative
from tidemark.operators.folds import Resume, keyed_fold, micros
from tidemark.operators.mining import CREATED

SECOND = 1_000_000
HOUR = 3600 * SECOND
NEW, RARE, SPIKE, SYMPTOM, MISSING = "log.new_template", "log.rare_template", "log.frequency_spike", "log.symptomatic_template", "log.missing_template"
SYMPTOMATIC, HEARTBEAT, NORMAL, IGNORE = "symptomatic", "heartbeat", "normal", "ignore"
SIGNALS = "seq long, ts_us long, kind string, score double, template_id string, template string, marking string"
DECAY = 0.3


@dataclass(frozen=True)
class LogConfig:
    learning_us: int = 300 * SECOND
    rare_count: int = 3
    rare_total: int = 500
    rare_interval_s: float = 3600.0
    bucket_us: int = 60 * SECOND
    spike_factor: float = 3.0
    spike_count: int = 10
    missing_factor: float = 3.0
    missing_count: int = 10
    scan_us: int = 30 * SECOND
    silence_s: float = 300.0
    all_templates: bool = False
    max_cv: float = 0.5
    hourly: bool = True
    hourly_seen: int = 50
    max_templates: int = 2000


@dataclass
class _Template:
    last_seen: int
    bucket: int
    text: str = ""
    marking: str | None = None
    count: int = 0
    mean: float = 0.0
    variance: float = 0.0
    intervals: int = 0
    in_bucket: int = 0
    baseline: float = 0.0
    spiked: bool = False
    missing: bool = False
    by_hour: list[int] = field(default_factory=lambda: [0] * 24)
    hour_baseline: list[float] = field(default_factory=lambda: [0.0] * 24)
    hour_folds: list[int] = field(default_factory=lambda: [0] * 24)

    def came(self, ts: int) -> None:
        gap = (ts - self.last_seen) / SECOND
        if self.count and gap >= 0:
            if self.mean == 0:
                self.mean = gap
            else:
                delta = gap - self.mean
                self.mean += DECAY * delta
                self.variance = (1 - DECAY) * (self.variance + DECAY * delta * delta)
                self.intervals += 1
        self.count += 1
        self.last_seen, self.missing = ts, False

    def roll(self, ts: int, width: int, hourly: bool) -> None:
        bucket = ts - ts % width
        if bucket > self.bucket:
            passed = (bucket - self.bucket) // width
            self.baseline += DECAY * (self.in_bucket - self.baseline)
            for _ in range(min(passed - 1, 60)):
                self.baseline *= 1 - DECAY
            if hourly:
                h = self.bucket // HOUR % 24
                self.hour_baseline[h] += DECAY * (self.in_bucket - self.hour_baseline[h])
                self.hour_folds[h] += 1
            self.bucket, self.in_bucket, self.spiked = bucket, 0, False
        self.in_bucket += 1


_TEMPLATE = (
    "last_seen:bigint,bucket:bigint,text:string,marking:string,count:bigint,mean:double,variance:double,intervals:bigint,in_bucket:bigint,baseline:double,"
    "spiked:boolean,missing:boolean,by_hour:array<bigint>,hour_baseline:array<double>,hour_folds:array<bigint>"
)


class Source:
    """The state of one source."""

    STATE = f"first_seen long, last_scan long, total long, hours array<long>, templates array<struct<template_id:string,{_TEMPLATE}>>"

    def state(self) -> tuple:
        return self.first_seen, self.last_scan, self.total, self.hours, [{"template_id": k, **vars(t)} for k, t in self.templates.items()]

    def restore(self, state: dict) -> None:
        self.first_seen, self.last_scan, self.total, self.hours = state["first_seen"], state["last_scan"], state["total"], list(state["hours"])
        for t in state["templates"]:
            own = {k: list(v) if isinstance(v, list) else v for k, v in t.items() if k != "template_id"}
            self.templates[t["template_id"]] = _Template(**own)

    def __init__(self, config: LogConfig = LogConfig()) -> None:
        self.config = config
        self.first_seen: int | None = None
        self.last_scan: int | None = None
        self.total = 0
        self.hours = [0] * 24
        self.templates: dict[str, _Template] = {}

    def step(self, seq: int, ts: int, template_id: str, text: str, change: str, marking: str | None, says: bool) -> Iterator[tuple]:
        c = self.config
        self.first_seen = ts if self.first_seen is None else self.first_seen
        self.total += 1
        t = self.templates.get(template_id)
        if t is None:
            while len(self.templates) >= c.max_templates:
                del self.templates[min(self.templates, key=lambda k: (self.templates[k].last_seen, k))]
            t = self.templates[template_id] = _Template(ts, ts - ts % c.bucket_us)
        t.text, t.marking = text, marking
        t.came(ts)
        hour = ts // HOUR % 24
        if c.hourly:
            self.hours[hour] += 1
            t.by_hour[hour] += 1
        t.roll(ts, c.bucket_us, c.hourly)
        if marking in (NORMAL, IGNORE):
            return
        out = lambda kind, score: (seq, ts, kind, score, template_id, text, marking)
        if marking == SYMPTOMATIC:
            yield out(SYMPTOM, 0.9)
        if says and ts - self.first_seen >= c.learning_us:
            if change == CREATED:
                yield out(NEW, 0.8)
            elif t.count <= c.rare_count and self.total >= c.rare_total and (c.rare_interval_s <= 0 or t.mean <= c.rare_interval_s):
                yield out(RARE, 0.6)
            usual = t.hour_baseline[hour] if c.hourly and t.hour_folds[hour] >= 3 else t.baseline
            if not t.spiked and usual > 0 and t.in_bucket >= max(c.spike_count, c.spike_factor * usual):
                t.spiked = True
                yield out(SPIKE, 0.7)
        yield from self._scan(seq, ts, hour)

    def finish(self) -> Iterator[tuple]:
        return iter(())

    def _scan(self, seq: int, ts: int, hour: int) -> Iterator[tuple]:
        c = self.config
        if c.missing_factor <= 0 or (self.last_scan is not None and ts - self.last_scan < c.scan_us):
            return
        self.last_scan = ts
        for key in sorted(self.templates):
            t = self.templates[key]
            if t.missing or t.count < c.missing_count or t.mean <= 0 or t.marking in (NORMAL, IGNORE):
                continue
            if not (c.all_templates or t.marking == HEARTBEAT):
                continue
            if c.hourly and not t.by_hour[hour] and self.hours[hour] >= c.hourly_seen:
                continue
            if c.max_cv > 0 and (t.intervals < 5 or math.sqrt(t.variance) / t.mean > c.max_cv):
                continue
            silence = (ts - t.last_seen) / SECOND
            if silence > max(c.missing_factor * t.mean, c.silence_s) and silence > c.scan_us / SECOND:
                t.missing = True
                yield seq, ts, MISSING, 0.9 if t.marking == HEARTBEAT else 0.6, key, t.text, t.marking


def detect(
    mined: DataFrame,
    config: LogConfig = LogConfig(),
    markings: dict[str, str] | None = None,
    patterns: dict[str, str] | None = None,
    min_literals: int = 8,
    max_ratio: float = 0.6,
    resume: Resume | None = None,
) -> DataFrame:
    """Signals over ``mined`` (source, seq, ts, template_id, template, change_type), in the order of ts and seq; ``resume``: goes on where an earlier run ended."""
    rows = mined.select(
        "source", "seq", micros("ts"), "template_id", "template", "change_type",
        best_marking(F.col("template"), markings or {}, patterns or {}).alias("marking"),
        informative(F.col("template"), min_literals, max_ratio).alias("says"),
    )
    ddl = SIGNALS.replace("seq long", f"seq {mined.schema['seq'].dataType.simpleString()}")
    return keyed_fold(rows, ["source"], ["ts", "seq"], ["seq", "ts", "template_id", "template", "change_type", "marking", "says"], lambda: Source(config), ddl, resume)
