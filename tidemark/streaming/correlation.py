"""Correlation over streams: windows and echoes that close by timers, events, and incidents that retire by timers.

Rows wait in the state store until the watermark has passed them and are then taken in order of time, so that the order in
which they come doesn't matter within ``late``; what a source says last comes out without any later word of it, as soon as
others have moved the watermark on.  The states are typed columns.

A stream is correlated in two stages.  The first is keyed by slots of time and carries changes to the signals of all
sources: it tells which signals are echoes of another source's change.  The second is keyed by source: windows of its own signals, and
sessions of its changes with the echoes that they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators import correlate, incidents
from tidemark.operators.folds import micros
from tidemark.shared import written
from tidemark.streaming.queries import append_once

EVENT, WALL = "event", "wall"
LATE = "10 seconds"
#: Event time is by so much ahead, since a stream's first watermark is 1970 and what isn't later than the watermark is dropped.
AHEAD_MS = 1
CHANGE, SIGNAL, TICK = 0, 1, 2
OWN, ECHO = "own", "echo"

_PLACED = "part string, source string, us long, what int, c_us long, body string, at timestamp"
_CLOSED = "part string, source string, start_us long, signals array<string>, changes array<string>"


def _moment(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class _Waiting(StatefulProcessor):
    """Rows that wait for the watermark in a list of the state store."""

    columns: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.columns)

    def waiting(self) -> list[tuple]:
        return list(self.rows.get()) if self.rows.exists() else []

    def keep(self, rows: list[tuple]) -> None:
        self.rows.put(rows) if rows else self.rows.clear()

    def wake(self, us: int) -> None:
        """A timer for when the watermark has passed ``us``."""
        self.handle.registerTimer(-(-us // 1000) + AHEAD_MS)

    @staticmethod
    def passed(timerValues) -> int:
        """The microsecond up to which all has come."""
        return (timerValues.getCurrentWatermarkInMs() - AHEAD_MS) * 1000

    def close(self) -> None:
        pass


class _Wakes(_Waiting):
    """A slot of time: every signal is placed, as its source's own or as the echo of another source's change, once all changes before it are there.

    Of changes two are carried along: the latest, and the latest of a source other than that one's.  They come to the slot of
    their own time and to the next, since slots are as wide as a change reaches.
    """

    columns = "us long, what int, source string, id string, asked boolean, home boolean, body string"

    def __init__(self, horizon: int, echo: int) -> None:
        self.horizon, self.echo = horizon, echo

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.own = handle.getMapState("own", "source string", "us long")
        pair = "us long, source string"
        self.latest, self.other = handle.getValueState("latest", pair), handle.getValueState("other", pair)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.what, r.source, r.id, r.asked, r.home, r.body) for r in rows]
        self.rows.appendList(new)
        self.wake(min(r[0] for r in new))
        self.wake((int(key[0]) + 1) * self.width + 1000)  # the slot is over
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.passed(timerValues)
        rows = self.waiting()
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        self.keep(rest)
        if rest:
            self.wake(min(r[0] for r in rest))
        # at one time changes come before signals, and of changes the first by source and id is the last to count
        due.sort(key=lambda r: r[3] or "", reverse=True)
        due.sort(key=lambda r: r[2], reverse=True)
        due.sort(key=lambda r: r[:2])
        latest = tuple(self.latest.get()) if self.latest.exists() else None
        other = tuple(self.other.get()) if self.other.exists() else None
        at, out = _moment(timerValues.getCurrentWatermarkInMs() + 1), []
        for us, what, source, _, asked, home, body in due:
            if what == CHANGE:
                self.own.updateValue((source,), (us,))
                if latest and latest[1] != source:
                    other = latest
                latest = (us, source)
                if home:
                    out += [Row(part=part, source=source, us=us, what=CHANGE, c_us=us, body=body, at=at) for part in (OWN, ECHO)]
                continue
            found = None
            if not asked and not (self.own.containsKey((source,)) and us - self.own.getValue((source,))[0] <= self.horizon):
                found = other if latest and latest[1] == source else latest
            if found and us - found[0] <= self.echo:
                out.append(Row(part=ECHO, source=found[1], us=us, what=SIGNAL, c_us=found[0], body=body, at=at))
            else:
                out.append(Row(part=OWN, source=source, us=us, what=SIGNAL, c_us=us, body=body, at=at))
        if latest:
            self.latest.update(latest)
        if other:
            self.other.update(other)
        if not rest and (int(key[0]) + 1) * self.width < now:
            for state in (self.own, self.latest, self.other):
                state.clear()
        return iter(out)

    @property
    def width(self) -> int:
        return max(self.horizon, self.echo, 1)


def _window(rows: list[tuple], start: int, width: int, horizon: int) -> tuple[int, list[str], list[str]]:
    signals = [b for us, what, _, b in rows if what == SIGNAL and us - start < width]
    return start, signals, [b for us, what, _, b in rows if what == CHANGE and start - horizon <= us <= start + width]


class _Closing(_Waiting):
    """A source's windows of signals and sessions of changes; each comes out when the watermark has passed its end."""

    columns = "us long, what int, c_us long, body string"

    def __init__(self, window: int, horizon: int, echo: int) -> None:
        self.window, self.horizon, self.echo = window, horizon, echo

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.what, r.c_us, r.body) for r in rows if r.what != TICK]
        if new:
            self.rows.appendList(new)
            if key[0] == ECHO:
                self.wake(min(r[2] for r in new) + self.echo + 1)
            elif signals := [r[0] for r in new if r[1] == SIGNAL]:
                self.wake(min(signals) + self.window)
            else:
                self.wake(min(r[0] for r in new) + self.horizon + self.window)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.passed(timerValues)
        rows = sorted(self.waiting())
        done, rest, then = (self._sessions if key[0] == ECHO else self._windows)(rows, now)
        self.keep(rest)
        if then is not None:
            self.wake(then)
        return iter([Row(part=key[0], source=key[1], start_us=s, signals=a, changes=b) for s, a, b in done])

    def _windows(self, rows: list[tuple], now: int) -> tuple[list[tuple], list[tuple], int | None]:
        done = []
        while (start := next((r[0] for r in rows if r[1] == SIGNAL), None)) is not None and start + self.window <= now:
            done.append(_window(rows, start, self.window, self.horizon))
            rows = [r for r in rows if r[1] == CHANGE or r[0] - start >= self.window]
        oldest = (now if start is None else min(start, now)) - self.horizon
        rest = [r for r in rows if r[1] == SIGNAL or r[0] >= oldest]
        if start is not None:
            return done, rest, start + self.window
        return done, rest, rest[0][0] + self.horizon + self.window if rest else None

    def _sessions(self, rows: list[tuple], now: int) -> tuple[list[tuple], list[tuple], int | None]:
        changes, signals = [r for r in rows if r[1] == CHANGE], [r for r in rows if r[1] == SIGNAL]
        sessions: list[list[tuple]] = []
        for r in changes:
            if sessions and r[0] - sessions[-1][-1][0] < self.echo:
                sessions[-1].append(r)
            else:
                sessions.append([r])
        done, rest, then = [], [], None
        for session in sessions:
            first, last = session[0][0], session[-1][0]
            followed = [r for r in signals if first <= r[2] <= last]
            if last + self.echo < now:
                if followed:
                    done.append((first, [r[3] for r in followed], [r[3] for r in session]))
            else:
                rest += session + followed
                then = last + self.echo + 1 if then is None else then
        return done, rest, then


class _WallWindows(_Waiting):
    """A source's windows by the clock of the machine: what came within the width after a first signal."""

    columns = "us long, what int, c_us long, body string"

    def __init__(self, window: int, horizon: int) -> None:
        self.window, self.horizon = window, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.what, r.c_us, r.body) for r in rows if r.what != TICK]
        if new:
            self.rows.appendList(new)
        if not self.due.exists() and any(r[1] == SIGNAL for r in new):
            ms = timerValues.getCurrentProcessingTimeInMs() + self.window // 1000
            self.due.update((ms,))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = sorted(self.waiting())
        signals = [r for r in rows if r[1] == SIGNAL]
        start = signals[0][0]
        near = [r[3] for r in rows if r[1] == CHANGE and start - self.horizon <= r[0] <= start + self.window]
        newest = max(r[0] for r in rows)
        self.keep([r for r in rows if r[1] == CHANGE and r[0] >= newest - self.horizon])
        self.due.clear()
        return iter([Row(part=key[0], source=key[1], start_us=start, signals=[r[3] for r in signals], changes=near)])


def _told(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[micros("ts") if c == "ts" else F.col(c) for c in df.columns]))


def _times() -> tuple[Column, Column]:
    ts = F.col("ts").cast("timestamp")
    return (ts + F.expr(f"INTERVAL {AHEAD_MS / 1000} SECOND")).alias("at"), F.unix_micros(ts).alias("us")


def _observed(signals: DataFrame, changes: DataFrame, ticks: DataFrame | None) -> DataFrame:
    """(at, us, what, source, id, asked, body) of all that comes."""
    none = F.lit(None).cast("string")
    asked = correlate.intended(F.col("kind"), F.col("marking") if "marking" in signals.columns else None)
    at, us = _times()
    rows = changes.select(at, us, F.lit(CHANGE).alias("what"), "source", F.col("change_id").cast("string").alias("id"), F.lit(False).alias("asked"), _told(changes).alias("body"))
    rows = rows.union(signals.select(at, us, F.lit(SIGNAL), "source", none, asked, _told(signals)))
    return rows if ticks is None else rows.union(ticks.select(at, us, F.lit(TICK), "source", none, F.lit(False), none))


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, ddl: str, mode: str, at: str = "") -> DataFrame:
    return df.groupBy(*keys).transformWithState(processor, StructType.fromDDL(ddl), "Append", mode, eventTimeColumnName=at)


def closed(
    signals: DataFrame, changes: DataFrame, ticks: DataFrame | None = None, window_s: float = correlate.WINDOW_S, horizon_s: int = correlate.HORIZON_S,
    echo_s: int = 0, clock: str = EVENT, late: str = LATE,
) -> DataFrame:
    """(part, source, start_us, signals, changes): every window of a source's own signals (part ``own``) that has closed with the changes near it, and
    every session of a source's changes (part ``echo``) with the signals of others that follow it, as JSON.

    ``signals`` (source, seq, ts, kind, ...), ``changes`` (source, change_id, ts, ...); rows of ``ticks`` (source, ts), such as observations, only tell
    how late it is.  ``clock``: ``event`` closes by the watermark, ``late`` behind the latest row of any source; ``wall`` closes by the
    machine's clock, the width after a window's first signal came, and knows no echoes.  ``echo_s``: how long after a change others' signals are its echo; 0: none are.
    """
    us = lambda s: int(s * 1_000_000)
    rows = _observed(signals, changes, ticks)
    alone = lambda df: df.select(F.lit(OWN).alias("part"), "source", "us", "what", F.col("us").alias("c_us"), "body", "at")
    if clock == WALL:
        if echo_s:
            raise ValueError("echoes need the clock of events")
        return _run(alone(rows), ["part", "source"], _WallWindows(us(window_s), us(horizon_s)), _CLOSED, "ProcessingTime")
    timed = rows.withWatermark("at", late)
    if not echo_s:
        return _run(alone(timed), ["part", "source"], _Closing(us(window_s), us(horizon_s), 0), _CLOSED, "EventTime")
    stage = _Wakes(us(horizon_s), us(echo_s))
    slot = F.floor(F.col("us") / stage.width)
    slots = F.when(F.col("what") == CHANGE, F.array(slot, slot + 1)).otherwise(F.array(slot))
    # ticks move the watermark, so the filter names its column, else it would go before it
    dealt = timed.filter((F.col("what") != TICK) | F.col("at").isNull()).withColumn("own_slot", slot).withColumn("slot", F.explode(slots)).withColumn("home", F.col("slot") == F.col("own_slot"))
    placed = _run(dealt.select("slot", "at", "us", "what", "source", "id", "asked", "home", "body"), ["slot"], stage, _PLACED, "EventTime", "at")
    return _run(placed, ["part", "source"], _Closing(us(window_s), us(horizon_s), us(echo_s)), _CLOSED, "EventTime")


def _parsed(rows: DataFrame, column: str, like: DataFrame, start: str) -> DataFrame:
    schema = StructType([StructField(f.name, LongType() if f.name == "ts" else f.dataType) for f in like.schema])
    each = rows.select("source", "start_us", F.explode(column).alias("x")).select(F.col("source").alias("_of"), F.col("start_us").alias(start), F.from_json("x", schema).alias("x"))
    return each.select("_of", start, "x.*").withColumn("ts", F.timestamp_micros("ts"))


def built(batch: DataFrame, signals: DataFrame, changes: DataFrame, window_s: float = correlate.WINDOW_S, horizon_s: int = correlate.HORIZON_S) -> DataFrame:
    """Events of ``closed``'s rows as ``correlate.build_events`` and ``correlate.echo_events`` give them; ``signals`` and ``changes`` name the columns."""
    own, echo = batch.filter(F.col("part") == OWN), batch.filter(F.col("part") == ECHO)
    near = _parsed(own, "changes", changes, "start").drop("_of", "start").dropDuplicates(["source", "change_id"])
    events = correlate.build_events(_parsed(own, "signals", signals, "window_us").drop("_of"), near, window_s, horizon_s)
    begun = lambda df: df.withColumn("session_start", F.timestamp_micros("session_start"))
    followed = begun(_parsed(echo, "signals", signals, "session_start").withColumnRenamed("_of", "changed"))
    of = begun(_parsed(echo, "changes", changes, "session_start").drop("_of"))
    return events.unionByName(correlate.wakes(followed, of), allowMissingColumns=True)


def events_to_log(
    signals: DataFrame, changes: DataFrame, path: str, checkpoint: str, ticks: DataFrame | None = None, window_s: float = correlate.WINDOW_S,
    horizon_s: int = correlate.HORIZON_S, echo_s: int = 0, clock: str = EVENT, late: str = LATE, **trigger,
) -> StreamingQuery:
    """Correlates streams as the batch does, and appends the events to the event log as windows close; arguments as of ``closed``.

    ``trigger``: as of ``DataStreamWriter.trigger``; by default all that is there is taken.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = written(batch)
        if not rows.isEmpty():
            events = written(built(rows, signals, changes, window_s, horizon_s))
            append_once(events.withColumnsRenamed({"event_id": "id", "ts": "timestamp"}), path)

    rows = closed(signals, changes, ticks, window_s, horizon_s, echo_s, clock, late)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Incidents(_Waiting):
    """Open incidents of all services; events join them in order of time, and an incident retires once no event can join it."""

    columns = "us long, event_id string, service string, change_keys array<string>"

    def __init__(self, config: incidents.GroupConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "id string, start long, last long, services array<string>, changes array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.event_id, r.service, list(r.change_keys or ())) for r in rows]
        self.rows.appendList(new)
        self.wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.passed(timerValues)
        rows = sorted(self.waiting(), key=lambda r: tuple(r[:2]))
        self.keep([r for r in rows if r[0] > now])
        fold = incidents.Grouping(self.config)
        fold.open = [incidents.Incident(i, s, t, set(a), set(b)) for i, s, t, a, b in (self.open.get() if self.open.exists() else ())]
        seen, out = {i.id for i in fold.open}, []
        for us, event_id, service, keys in rows:
            if us <= now:
                out += [Row(incident_id=incident, event_id=event, closed=False) for event, incident in fold.step(event_id, event_id, us, us, service, keys)]
                seen.add(out[-1].incident_id)
        fold.open = [i for i in fold.open if now - i.last <= self.config.gap_us]
        out += [Row(incident_id=i, event_id=None, closed=True) for i in sorted(seen - {i.id for i in fold.open})]
        kept = [(i.id, i.start, i.last, sorted(i.services), sorted(i.changes)) for i in fold.open]
        self.open.put(kept) if kept else self.open.clear()
        later = [r[0] for r in rows if r[0] > now] + [i.last + self.config.gap_us + 1 for i in fold.open]
        if later:
            self.wake(min(later))
        return iter(out)


def incident_members(events: DataFrame, config: incidents.GroupConfig = incidents.GroupConfig(), late: str = LATE) -> DataFrame:
    """(incident_id, event_id, closed) of streamed ``events`` (event_id string, ts, service, change_keys), as ``incidents.group_events`` has them.

    An event's row comes when the watermark has passed it.  When no event can join an incident any more, a row without an event says
    that it is closed, so that what it holds may be reported.  An incident can take events of any source, so they are one key; its state is
    the open incidents and the events that wait, of the last ``gap`` only.
    """
    at, us = _times()
    rows = events.select(at, us, "event_id", F.coalesce("service", F.lit("")).alias("service"), "change_keys").withWatermark("at", late).withColumn("all", F.lit(0))
    return _run(rows, ["all"], _Incidents(config), "incident_id string, event_id string, closed boolean", "EventTime")
