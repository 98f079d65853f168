"""Dampening of repeats, one fold a pattern: silence doubles while a pattern keeps coming."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import caps
from tidemark.operators.folds import keyed_fold, micros

HOUR = 3_600_000_000
REPORTED = "seq long, ts_us long, score double, reported boolean, suppressed long, repeats int, escalated_from double"


@dataclass(frozen=True)
class DampenConfig:
    cooldown_us: int = HOUR
    longest_us: int = 12 * HOUR
    escalation: float = 0.1
    max_tracked: int = 0  # patterns remembered at most, of which the oldest tenth goes for a new one; 0: no limit


class Pattern:
    def __init__(self, config: DampenConfig = DampenConfig()) -> None:
        self.config = config
        self.reported_at: int | None = None
        self.last_seen = self.streak = self.suppressed = 0
        self.top = 0.0

    def silence(self) -> int:
        return min(self.config.longest_us, self.config.cooldown_us << min(self.streak, 40))

    def step(self, seq: int, ts: int, score: float, fresh: bool = False) -> Iterator[tuple]:
        if fresh:
            self.__init__(self.config)
        if self.config.cooldown_us <= 0:
            yield seq, ts, score, True, 0, 0, None
            return
        report, escalated = self._admit(ts, score)
        held = self.suppressed
        if report:
            self.reported_at, self.suppressed = ts, 0
            yield seq, ts, score, True, held, self.streak, escalated
        else:
            self.suppressed += 1
            yield seq, ts, score, False, 0, 0, None

    def finish(self) -> Iterator[tuple]:
        return iter(())

    def _admit(self, ts: int, score: float) -> tuple[bool, float | None]:
        if self.reported_at is None:
            self.last_seen, self.top = ts, score
            return True, None
        back = ts - self.last_seen > self.silence()
        if back:
            self.streak = 0
        self.last_seen = ts
        if score >= self.top + self.config.escalation:
            old, self.top, self.streak = self.top, score, 0
            return True, old
        if ts - self.reported_at >= self.silence():
            self.streak += not back
            self.top = score
            return True, None
        return False, None


def pattern_key(template: Column, series: Column, metric: Column, summary: Column) -> Column:
    """What a repeat repeats: the first of these that is there."""
    return F.coalesce(*[F.when(c != "", c) for c in (template, series, metric, summary)], F.lit(""))


def dampen(signals: DataFrame, config: DampenConfig = DampenConfig()) -> DataFrame:
    """``signals`` (kind, source, pattern, seq, ts, score): whether each is reported, and what a report stands for."""
    rows = signals.select("kind", "source", "pattern", "seq", micros("ts"), "score")
    ddl = REPORTED.replace("seq long", f"seq {signals.schema['seq'].dataType.simpleString()}")
    keys, columns, most = ["kind", "source", "pattern"], ["seq", "ts", "score"], config.max_tracked
    if most > 0 and config.cooldown_us > 0:
        rows, columns = caps.marked(rows, keys, ["ts", "seq"], most, most // 10 + 1), [*columns, "fresh"]
    return keyed_fold(rows, keys, ["ts", "seq"], columns, lambda: Pattern(config), ddl)
