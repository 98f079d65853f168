"""Correlation of signals with each other and with changes.

Signals: kind, modality, source, ts, score, seq and merge_key (kind, template and metric).  Changes: source,
ts, type, version, summary.  Windows hang on the first signal of a source, which takes an ordered fold;
everything else is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import keyed_fold, micros
from tidemark.shared import running, written

WINDOW_S, HORIZON_S, ECHO_S, CONTEXT = 30, 900, 600, 10
#: Changes that an event names at most, the latest ones.
MAX_CHANGES = 64
#: The wording of an echo's summary.
ECHO_SIGNALS, ECHO_SOURCES = " signals from ", " sources in the wake of "
INTENDED = ("log.symptomatic_template", "metric.threshold")


def seconds(c: Column) -> Column:
    """Seconds since 1970 with fractions."""
    return F.unix_micros(c.cast("timestamp")) / 1_000_000


class _Anchored:
    """Numbers windows that open with a signal and close ``width`` after it."""

    STATE = "start long"

    def state(self) -> tuple:
        return (self.start,)

    def restore(self, state: dict) -> None:
        self.start = state["start"]

    def __init__(self, width_us: int) -> None:
        self.width, self.start = width_us, None

    def step(self, seq, ts: int) -> Iterator[tuple]:
        if self.start is None or ts - self.start >= self.width:
            self.start = ts
        yield seq, self.start

    def finish(self) -> Iterator[tuple]:
        return iter(())


def anchored_windows(signals: DataFrame, width_s: float = WINDOW_S) -> DataFrame:
    """``signals`` with window_us: microseconds of the first signal of their window of their source.

    A signal at exactly the width after the first opens the next window.  ``seq`` is unique in a source.
    """
    rows = signals.select("source", "seq", micros("ts"))
    kind = signals.schema["seq"].dataType.simpleString()
    width = int(width_s * 1_000_000)
    opened = keyed_fold(rows, ["source"], ["ts", "seq"], ["seq", "ts"], lambda: _Anchored(width), f"seq {kind}, window_us long")
    return signals.join(opened, ["source", "seq"])


def merge_signals(signals: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and merge_key: the strongest signal (the first of equals) and how many there were."""
    order = F.struct(-F.col("score"), F.col("ts"), F.col("seq"))
    rest = [c for c in ("kind", "modality", "score", "ts", "seq", "summary", "marking") if c in signals.columns]
    return signals.groupBy(*by, "merge_key").agg(F.min_by(F.struct(*rest), order).alias("s"), F.count("*").alias("occurrences")).select(
        *by, "merge_key", "s.*", "occurrences"
    )


def confidence(scores: Column) -> Column:
    """1 - the product of what each score leaves, at most 0.99; scores in falling order, so that sums agree."""
    left = F.aggregate(F.sort_array(scores, False), F.lit(1.0), lambda acc, s: acc * (1 - F.least(s, F.lit(0.99))))
    return F.least(F.lit(0.99), 1 - left)


def intended(kind: Column, marking: Column | None = None) -> Column:
    """Signals that someone asked for."""
    heartbeat = (kind == "log.missing_template") & (F.coalesce(marking, F.lit("")) == "heartbeat") if marking is not None else F.lit(False)
    return kind.isin(*INTENDED) | heartbeat


def severity(conf: Column, multimodal: Column, near_change: Column, has_log: Column, asked_for: Column) -> Column:
    sure = multimodal | (near_change & has_log) | asked_for
    return F.when(conf < 0.6, "info").when(conf < 0.85, "warning").when(sure, "critical").otherwise("warning")


def combine(merged: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of merged signals: confidence, multimodal, has_log, asked_for, signals (strongest first)."""
    more = [c for c in ("summary", "marking") if c in merged.columns]
    each = F.struct((-F.col("score")).alias("order"), "kind", "merge_key", "score", "occurrences", "ts", "modality", *more)
    marking = F.col("marking") if "marking" in more else None
    return merged.groupBy(*by).agg(
        confidence(F.collect_list("score")).alias("confidence"),
        (F.bool_or(F.col("modality") == "log") & F.bool_or(F.col("modality") == "metric")).alias("multimodal"),
        F.bool_or(F.col("modality") == "log").alias("has_log"),
        F.bool_or(intended(F.col("kind"), marking)).alias("asked_for"),
        F.transform(F.sort_array(F.collect_list(each)), lambda s: s.dropFields("order")).alias("signals"),
    )


def _slots(lo: Column, hi: Column, width: int) -> Column:
    """The time slots of ``width`` that [lo, hi] touch."""
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def related_changes(events: DataFrame, changes: DataFrame, horizon_s: int = HORIZON_S, window_s: float = WINDOW_S) -> DataFrame:
    """(event_id, change_id, offset_seconds): changes of the event's source from the horizon before to the window after.

    Both sides meet on source and slots of time, so that a source with many events and changes is split by time.  A slot is as
    wide as the time that a change is near, so a change comes to two, however long the horizon.  Spark expects as many rows from
    that step as go in, and by such an estimate might send a side through the driver; so the join is by merging.
    """
    back, on = round(horizon_s * 1_000_000), round(window_s * 1_000_000)
    width = max(back + on, 1)
    e = events.select("event_id", "source", micros("ts").alias("e_us")).withColumn("slot", F.floor(F.col("e_us") / width))
    c = changes.select("change_id", "source", micros("ts").alias("c_us")).withColumn("slot", F.explode(_slots(F.col("c_us") - on, F.col("c_us") + back, width)))
    offset = F.col("c_us") - F.col("e_us")
    near = e.join(c.hint("merge"), ["source", "slot"]).filter(offset.between(-back, on))
    return near.select("event_id", "change_id", F.round(offset / 1_000_000, 6).alias("offset_seconds"))


def _latest_change(signals: DataFrame, changes: DataFrame, width_s: float, own: bool) -> DataFrame:
    """``signals`` (seq, source, us) that have a change within ``width_s`` before, with c_us, change_id and echo_source of the latest.

    ``own``: changes of the signal's source, else of any other; of changes at once, the first by source and id.  Signals and
    changes are put in order of time, by slots as wide as ``width_s``, and each signal takes what is carried to it, so that
    the work is in proportion to both, however many fall into a slot.  Of other sources' changes two are carried: the
    latest, and the latest of a source other than that one's.
    """
    width = int(width_s * 1_000_000)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    slot = F.floor(F.col("us") / max(width, 1))
    c = changes.select("source", micros("ts").alias("us"), "change_id", none(signals, "seq").alias("seq"), F.lit(0).alias("what"))
    c = c.withColumn("slot", F.explode(F.array(slot, slot + 1)))
    s = signals.select("source", "us", none(changes, "change_id").alias("change_id"), "seq", F.lit(1).alias("what"), slot.alias("slot"))
    by = ["source", "slot"] if own else ["slot"]
    order = Window.partitionBy(*by).orderBy("us", "what", F.col("source").desc(), F.col("change_id").desc())
    change = F.when(F.col("what") == 0, F.struct(F.col("us").alias("c_us"), F.col("source").alias("echo_source"), "change_id"))
    rows = c.union(s.select(*c.columns)).withColumn("latest", F.last(change, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if own:
        pick = F.col("latest")
    else:
        before = F.last(change, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("before", before)
        turn = F.when((F.col("what") == 0) & (F.col("before.echo_source") != F.col("source")), F.col("before"))
        rows = rows.withColumn("other", F.last(turn, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        pick = F.when(F.col("latest.echo_source") != F.col("source"), F.col("latest")).otherwise(F.col("other"))
    found = rows.filter("what = 1").select("seq", "source", "us", pick.alias("c"))
    return found.filter(F.col("us") - F.col("c.c_us") <= width).select("seq", "source", "us", "c.c_us", "c.change_id", "c.echo_source")


def echoes(signals: DataFrame, changes: DataFrame, horizon_s: int = HORIZON_S, echo_s: int = ECHO_S) -> DataFrame:
    """(seq, change_id, echo_source, delay_seconds): signals that another source's change explains.

    Only signals not asked for, of sources without a change of their own in the horizon before; of the changes of
    other sources within ``echo_s`` before, the latest counts, ties by source.
    """
    marking = F.col("marking") if "marking" in signals.columns else None
    s = signals.filter(~intended(F.col("kind"), marking)).select("seq", "source", micros("ts").alias("us"))
    free = s.join(_latest_change(s, changes, horizon_s, own=True).select("seq"), "seq", "left_anti")
    found = _latest_change(free, changes, echo_s, own=False)
    return found.select("seq", "change_id", "echo_source", F.round((F.col("us") - F.col("c_us")) / 1_000_000, 6).alias("delay_seconds"))


def change_sessions(changes: DataFrame, echo_s: int = ECHO_S) -> DataFrame:
    """(source, session_start, session_end, n_changes): changes of a source that follow each other within the echo window."""
    return changes.groupBy("source", F.session_window("ts", f"{echo_s} seconds").alias("w")).agg(F.count("*").alias("n_changes")).select(
        "source", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_changes"
    )


def session_members(changes: DataFrame, echo_s: int = ECHO_S) -> DataFrame:
    """``changes`` with session_start, the first of the session that each belongs to."""
    sessions = change_sessions(changes, echo_s).select("source", "session_start", "session_end")
    lo, hi = seconds(F.col("session_start")), seconds(F.col("session_end"))
    sessions = sessions.withColumn("slot", F.explode(_slots(lo, hi, echo_s)))
    rows = changes.withColumn("slot", F.floor(seconds(F.col("ts")) / echo_s))
    at = F.col("ts").cast("timestamp")
    inside = (at >= F.col("session_start").cast("timestamp")) & (at < F.col("session_end").cast("timestamp"))
    return rows.join(sessions, ["source", "slot"]).filter(inside).select(*changes.columns, "session_start")


def _latest_changes(pairs: DataFrame, by: list[str], columns: list[str], most: int = MAX_CHANGES) -> DataFrame:
    """``pairs`` gathered per ``by``: related_changes, of the latest ``most`` by offset_seconds."""
    latest = Window.partitionBy(*by).orderBy(F.col("offset_seconds").desc(), F.col("change_id").desc())
    few = pairs.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= most)
    return few.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("offset_seconds", "change_id", *columns))).alias("related_changes"))


def _told(changes: DataFrame) -> list[str]:
    return [c for c in ("type", "version", "summary") if c in changes.columns]


def _attributes(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def echo_events(signals: DataFrame, changes: DataFrame, horizon_s: int = HORIZON_S, echo_s: int = ECHO_S) -> DataFrame:
    """One event for each session of a source's changes that others' signals follow: what happened in its wake.

    The changes explain the signals, so they can't corroborate them: an echo is a warning at most.  Columns are those of
    ``build_events``; ``source`` is that of the changes.
    """
    of = session_members(changes, echo_s)
    found = echoes(signals, changes, horizon_s, echo_s).join(of.select("change_id", F.col("session_start")), "change_id")
    return wakes(found.select("seq", F.col("echo_source").alias("changed"), "session_start").join(signals, "seq"), of)


def wakes(signals: DataFrame, of: DataFrame) -> DataFrame:
    """Echo events of ``signals`` with ``changed`` and ``session_start``: the source and session of the change that each follows; ``of``: changes with their session."""
    told = _told(of)
    own = [c for c in ("summary", "marking") if c in signals.columns]
    rows = signals.select(
        "seq", F.col("changed").alias("source"), "session_start", F.col("source").alias("from"), "kind", "modality", "score", "ts", *own, F.concat_ws("\0", "source", "merge_key").alias("merge_key")
    )
    by = ["source", "session_start"]
    sources = rows.groupBy(*by).agg(F.array_sort(F.collect_set("from")).alias("sources"), F.min("ts").alias("ts"), F.count("*").alias("instances"))
    events = combine(merge_signals(rows, by), by).join(sources, by)
    pairs = of.select(*by, "change_id", F.col("ts").alias("c_ts"), *told).join(events.select(*by, "ts"), by)
    pairs = pairs.withColumn("offset_seconds", F.round(seconds(F.col("c_ts")) - seconds(F.col("ts")), 6))
    out = events.join(_latest_changes(pairs, by, told), by)
    n, names = F.size("signals"), F.array_join("sources", ", ")
    latest = F.element_at("related_changes", -1)
    what = F.concat(F.coalesce(latest["type"], F.lit("change")), F.lit(" ")) if "type" in told else F.lit("")
    return out.select(
        F.substring(F.sha2(F.concat_ws("\x1f", F.lit("echo"), "source", F.unix_micros(F.col("session_start").cast("timestamp")).cast("string")), 256), 1, 32).alias("event_id"),
        F.lit("anomaly.change_echo").alias("kind"),
        "source",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("confidence") < 0.6, "info").otherwise("warning").alias("severity"),
        "confidence",
        n.cast("long").alias("n_signals"),
        "signals",
        "related_changes",
        F.concat(n.cast("string"), F.lit(ECHO_SIGNALS), F.size("sources").cast("string"), F.lit(ECHO_SOURCES), what, "source", F.lit(": "), names).alias("summary"),
        _attributes(signal_count=n, signal_instances=F.col("instances"), multimodal=F.col("multimodal"), sources=F.array_join("sources", ",")).alias("attributes"),
    )


def context(observations: DataFrame, before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """``observations`` (source, ts, seq, ...) with the seqs up to and after each, of the same source."""
    w = Window.partitionBy("source").orderBy("ts", "seq")
    return observations.withColumn("before", F.collect_list("seq").over(w.rowsBetween(1 - before, 0))).withColumn(
        "after", F.collect_list("seq").over(w.rowsBetween(1, after))
    )


def event_context(events: DataFrame, observations: DataFrame, window_s: float = WINDOW_S, before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """(event_id, before, after): seqs of observations of the event's source up to its first signal's, and after it until its window closes.

    ``events`` (event_id, source, ts, first_seq), ``observations`` (source, ts, seq).  Observations are numbered over ranges of source
    and time, and events fetch the numbers around their own, so that no source is gathered.
    """
    rows = written(running(observations.select("source", "ts", "seq"), ["source", "ts", "seq"], {"n": F.lit(1).cast("long")}))
    own = events.select("event_id", "source", F.col("ts").alias("e_ts"), F.col("first_seq").alias("seq")).join(rows.select("source", "seq", "n"), ["source", "seq"])
    wanted = own.select("event_id", "source", "e_ts", F.col("n").alias("own"), F.explode(F.sequence(F.col("n") - (before - 1), F.col("n") + after)).alias("n"))
    near = wanted.join(rows.select("source", "n", "ts", "seq"), ["source", "n"])
    close = seconds(F.col("ts")) - seconds(F.col("e_ts")) < window_s
    part = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("n", "seq")))), lambda x: x["seq"])
    return near.groupBy("event_id").agg(part(F.col("n") <= F.col("own")).alias("before"), part((F.col("n") > F.col("own")) & close).alias("after"))


def build_events(signals: DataFrame, changes: DataFrame, window_s: float = WINDOW_S, horizon_s: int = HORIZON_S, observations: DataFrame | None = None) -> DataFrame:
    """From signals to events: windows, merging, combination, related changes and severity.

    Events carry what their signals do: summary, service and environment if there; with ``observations`` (source, ts, seq) also
    the context of their first signal's.  Signals that come with window_us, as of ``anchored_windows``, keep their windows.
    """
    windows = signals if "window_us" in signals.columns else anchored_windows(signals, window_s)
    by = ["source", "window_us"]
    named = [c for c in ("service", "environment") if c in signals.columns]
    firsts = windows.groupBy(*by).agg(F.min(F.struct("ts", "seq", *named)).alias("first"), F.count("*").alias("instances"))
    events = combine(merge_signals(windows, by), by).join(firsts, by)
    events = events.withColumn("ts", F.timestamp_micros("window_us")).withColumn(
        "event_id", F.substring(F.sha2(F.concat_ws("\x1f", "source", F.col("window_us").cast("string")), 256), 1, 32)
    )
    pairs = related_changes(events, changes, horizon_s, window_s)
    told = _told(changes)
    if told:
        pairs = pairs.join(changes.select("change_id", *told), "change_id")
    out = events.join(_latest_changes(pairs, ["event_id"], told), "event_id", "left")
    if observations is not None:
        near = event_context(events.select("event_id", "source", "ts", F.col("first.seq").alias("first_seq")), observations, window_s)
        out = out.join(near, "event_id", "left")
    n, strongest = F.size("signals"), F.col("signals")[0]
    more = []
    if "summary" in signals.columns:
        more.append(F.when(n > 1, F.concat(strongest["summary"], F.lit(" (+"), (n - 1).cast("string"), F.lit(" correlated signals)"))).otherwise(strongest["summary"]).alias("summary"))
    more += [F.col(f"first.{c}").alias(c) for c in named]
    more += ["before", "after"] if observations is not None else []
    return out.select(
        "event_id",
        F.when(n > 1, "anomaly.correlated").otherwise(F.concat(F.lit("anomaly."), strongest["kind"])).alias("kind"),
        "source",
        "ts",
        severity(F.col("confidence"), F.col("multimodal"), F.col("related_changes").isNotNull(), F.col("has_log"), F.col("asked_for")).alias("severity"),
        "confidence",
        n.cast("long").alias("n_signals"),
        "signals",
        "related_changes",
        *more,
        _attributes(signal_count=n, signal_instances=F.col("instances"), multimodal=F.col("multimodal")).alias("attributes"),
    )
