"""Incidents: anomaly events grouped over sources by time, service and shared changes.

An event joins the open incident that it relates to (same service, a shared change, or close in time),
the one with the latest event if several; this is a fold over events in order.  Events that follow each other closely
join the same incident, so they are condensed into pieces first, by windows over ranges of time, and only pieces
are folded.  Events more than ``gap`` after all others begin anew, so the fold runs over islands of time that a whole empty slot divides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import severity_name, severity_rank
from tidemark.operators.folds import keyed_fold, micros
from tidemark.shared import carried, running, written

MINUTE = 60_000_000


@dataclass(frozen=True)
class GroupConfig:
    gap_us: int = 30 * MINUTE
    longest_us: int = 60 * MINUTE
    together_us: int = MINUTE // 2


@dataclass
class Incident:
    id: str
    start: int
    last: int
    services: set[str] = field(default_factory=set)
    changes: set[str] = field(default_factory=set)


class Grouping:
    def __init__(self, config: GroupConfig = GroupConfig()) -> None:
        self.config, self.open = config, []

    def step(
        self, key, event_id, ts: int, last: int, service: str, changes: list[str] | None, services: list[str] | None = None, all_changes: list[str] | None = None
    ) -> Iterator[tuple]:
        """An event, or the first of a piece of events up to ``last``, of which ``services`` and ``all_changes`` are those of all."""
        c, own = self.config, set(changes or ())
        self.open = [i for i in self.open if ts - i.last <= c.gap_us]
        related = [
            i for i in self.open
            if ts - i.start <= c.longest_us and (service in i.services or own & i.changes or ts - i.last <= c.together_us)
        ]
        if related:
            incident = max(related, key=lambda i: i.last)  # the first opened of equals
        else:
            incident = Incident(event_id, ts, ts)
            self.open.append(incident)
        incident.last = last
        incident.services |= {service, *(services or ())}
        incident.changes |= own.union(all_changes or ())
        yield key, incident.id

    def finish(self) -> Iterator[tuple]:
        return iter(())


def islands(spans: DataFrame, gap_us: int) -> DataFrame:
    """``spans`` (us, last, in microseconds) with island: the number of the run of slots of ``gap_us`` that they all touch."""
    slot = lambda c: F.floor(F.col(c) / gap_us)
    slots = written(spans.select(F.explode(F.sequence(slot("us"), slot("last"))).alias("slot")).distinct())
    follows = slots.select((F.col("slot") + 1).alias("slot"), F.lit(0).alias("opens"))
    opening = slots.join(follows, "slot", "left").withColumn("opens", F.coalesce("opens", F.lit(1)).cast("long"))
    named = running(opening, ["slot"], {"island": F.col("opens")}).select(F.col("slot").alias("_slot"), "island")
    return spans.withColumn("_slot", slot("us")).join(named, "_slot").drop("_slot")


def _heads(events: DataFrame, config: GroupConfig) -> DataFrame:
    """``events`` (event_id, us, ...) with head: whether the event is one whose incident the event before doesn't decide.

    An event close to the one before joins its incident, unless that has lasted too long.  So heads are the events after a
    pause, and the first after the longest duration of an incident that a head began, and so on from head to head.  Every event's
    next is found in order of time; the way from head to head is doubled in each round.
    """
    rows = carried(events, ["us", "event_id"], "_before", F.col("us"))
    rows = written(rows.withColumn("_opens", F.col("_before").isNull() | (F.col("us") - F.col("_before") > config.together_us)).drop("_before"))
    heads = rows.filter("_opens").select("event_id")
    # the first event later than an incident's end, where no pause comes before it: events and ends in falling order of time
    none = F.lit(None)
    own = rows.select("event_id", F.col("us").alias("_at"), F.lit(1).alias("_what"), F.struct("us", "event_id", "_opens").alias("_event"))
    ends = rows.select("event_id", (F.col("us") + config.longest_us).alias("_at"), F.lit(0).alias("_what"), none.cast(own.schema["_event"].dataType).alias("_event"))
    after = carried(own.union(ends), ["-_at", "_what", "-event_id"], "_next", F.col("_event")).filter("_what = 0")
    close = (F.col("_next.us") - F.col("_at") <= config.together_us) & ~F.col("_next._opens")
    jump = written(after.filter(close).select("event_id", F.col("_next.event_id").alias("next")))
    while not jump.isEmpty():
        reached = jump.join(heads, "event_id").select(F.col("next").alias("event_id"))
        heads = written(heads.union(reached).distinct())
        ahead = jump.select(F.col("event_id").alias("next"), F.col("next").alias("_next"))
        jump = written(jump.join(ahead, "next").select("event_id", F.col("_next").alias("next")))
    return rows.join(heads.withColumn("head", F.lit(True)), "event_id", "left").drop("_opens").withColumn("head", F.coalesce("head", F.lit(False)))


def service_of(service: Column, source: Column) -> Column:
    return F.coalesce(F.when(service != "", service), source)


def group_events(events: DataFrame, config: GroupConfig = GroupConfig()) -> DataFrame:
    """``events`` (event_id, ts, service, change_keys): (event_id, incident_id); an incident has the id of its first event.

    Events are unique.  Heads with the events up to the next head are pieces, which join incidents as a whole; only pieces are folded, an island in a task.
    """
    kind = events.schema["event_id"].dataType.simpleString()
    rows = events.select("event_id", micros("ts").alias("us"), "service", F.coalesce("change_keys", F.array().cast("array<string>")).alias("change_keys"))
    found = _heads(rows, config)
    placed = written(running(found, ["us", "event_id"], {"piece": F.col("head").cast("long")}))
    first = placed.filter("head").select("piece", F.col("event_id").alias("first_id"), F.col("service").alias("first_service"), F.col("change_keys").alias("first_changes"))
    each = placed.groupBy("piece").agg(F.min("us").alias("us"), F.max("us").alias("last"), F.collect_set("service").alias("services"))
    changes = placed.select("piece", F.explode("change_keys").alias("k")).groupBy("piece").agg(F.collect_set("k").alias("changes"))
    pieces = written(each.join(first, "piece").join(changes, "piece", "left"))
    columns = ["piece", "first_id", "us", "last", "first_service", "first_changes", "services", "changes"]
    members = keyed_fold(
        islands(pieces, config.gap_us), ["island"], ["us", "piece"], columns, lambda: Grouping(config), f"piece long, incident_id {kind}"
    )
    return placed.select("event_id", "piece").join(members.select("piece", "incident_id"), "piece").select("event_id", "incident_id")


def incident_table(events: DataFrame, members: DataFrame) -> DataFrame:
    """One row an incident: span, strongest severity and confidence, services in order of appearance, title."""
    rows = events.join(members, "event_id")
    firsts = rows.groupBy("incident_id", "service").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    services = firsts.groupBy("incident_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first", "service"))), lambda s: s["service"]).alias("services")
    )
    spans = rows.groupBy("incident_id").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("n_events"),
        F.min_by(F.struct("service", "summary"), F.struct("ts", "event_id")).alias("trigger"),
    )
    return spans.join(services, "incident_id").withColumn(
        "title", title(F.col("trigger.service"), F.col("trigger.summary"), F.size("services"))
    ).drop("trigger")


def title(service: Column, summary: Column, n_services: Column) -> Column:
    short = F.regexp_replace(F.rtrim(F.substring_index(summary, "(", 1)), ":+$", "")
    more = F.when(n_services == 2, " (+1 service)").when(n_services > 2, F.format_string(" (+%d services)", n_services - 1)).otherwise("")
    return F.concat(service, F.lit(": "), short, more)


def evidence(signals: DataFrame) -> DataFrame:
    """``signals`` (incident_id, kind, source, score, summary, ts, seq) per incident, kind and source; of the strongest, the last speaks."""
    return signals.groupBy("incident_id", "kind", "source").agg(
        F.count("*").alias("n_signals"),
        F.max("score").alias("score"),
        F.max_by("summary", F.struct("score", "seq")).alias("summary"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def incident_list(incidents: DataFrame, since: Column | None = None, least: str = "info") -> DataFrame:
    """Incidents that end at ``since`` or later, of that severity or more, the newest first."""
    rank = {"info": 1, "warning": 2, "critical": 3}[least]
    out = incidents.filter(severity_rank(F.col("severity")) >= rank)
    return (out.filter(F.col("end") >= since) if since is not None else out).orderBy(F.col("start").desc(), "incident_id")
