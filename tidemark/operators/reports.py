"""Incidents as text and Markdown, a column of one report an incident; debug events; counters of a pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.series import humanized, signed

CONTEXT_LINES = 40
GLOSSARY = (
    ("log.new_template", "A log line of a shape not seen before, after its source's learning period."),
    ("log.rare_template", "A template that a busy source hardly ever has."),
    ("log.frequency_spike", "Far more lines of a template in a minute than is usual, at this hour if that is learned."),
    ("log.missing_template", "A template that came regularly and has been silent for much longer than its usual interval."),
    ("log.symptomatic", "A template that someone has marked as a symptom."),
    ("metric.zscore", "A sample many standard deviations away from its series' learned mean."),
    ("metric.threshold", "A sample beyond a bound that someone has set."),
    ("metric.trend_drift", "A quick average that has left the slow one: a lasting move, no spike."),
)
HOW_TO_READ = """## How to read this

- Logs, metrics and declared changes are compared with what their own source usually does; departures are signals,
  signals of one source close in time are one event, and events close to each other make an incident.
- Words in angle brackets, such as `<NUM>`, stand for values masked in log templates; `<*>` stands for any word.
- The first event of an incident is the first in time, not necessarily its cause.
- Evidence has a row for each kind and source; its summary is the strongest signal's.
- Severity grades the distance from what is usual, not the harm done; confidence is how sure it is that it departs at all.
- Changes are listed because they are near in time. That doesn't show that they caused anything.
- What isn't collected can't be seen, and trouble that was there while learning looks usual.
"""


def incident_changes(events: DataFrame, members: DataFrame) -> DataFrame:
    """Changes of each incident, at the time that their first mention gives.

    ``events`` (event_id, ts, related_changes: array of structs with type, version, summary, offset_seconds).
    """
    c = events.join(members, "event_id").select("incident_id", "event_id", "ts", F.posexplode("related_changes").alias("n", "c"))
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("c.offset_seconds") * 1_000_000).cast("bigint"))
    first = F.min_by(at, F.struct("ts", "event_id", "n"))
    return c.groupBy("incident_id", F.col("c.type").alias("type"), F.col("c.version").alias("version"), F.col("c.summary").alias("summary")).agg(first.alias("at"))


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def cell(text: Column) -> Column:
    """Text that can stand in a cell of a Markdown table."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " ")


def _gathered(rows: DataFrame, line: Column, order: list[str], name: str) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy("incident_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias(name))


def preamble(incidents: DataFrame, since: str | None = None, until: str | None = None, glossary: bool = True) -> DataFrame:
    """One row, (report): what a Markdown report has before its incidents: its scope, how to read it, the kinds of signals."""
    span = f"{since} to {until}" if since and until else f"since {since}" if since else f"up to {until}" if until else "all that is kept"
    kinds = "### Kinds of signals\n\n| kind | meaning |\n|---|---|\n" + "\n".join(f"| `{k}` | {text} |" for k, text in GLOSSARY) if glossary else ""
    count = F.concat(F.lit("- Incidents: "), F.count("*").cast("string"))
    none = F.when(F.count("*") == 0, "## Incidents\n\nNone: nothing departed from what is usual, which isn't to say that all is well.\n")
    parts = F.lit(f"# Incidents\n\n## Scope\n\n- Period: {span}"), count, F.lit(""), F.lit(HOW_TO_READ), F.lit(kinds), none
    return incidents.agg(F.concat_ws("\n", *parts).alias("report"))


def excerpts(events: DataFrame, members: DataFrame, observations: DataFrame, most: int = CONTEXT_LINES) -> DataFrame:
    """(incident_id, excerpt): raw log lines around the first event of each incident, the first ``most`` of them.

    ``events`` (event_id, before, after: ids of observations), ``observations`` as of ``schema.OBSERVATION``.
    """
    first = members.filter(F.col("event_id") == F.col("incident_id"))  # an incident has its first event's id
    empty = F.array().cast(events.schema["before"].dataType)
    ids = F.concat(F.coalesce("before", empty), F.coalesce("after", empty))
    own = events.join(first, "event_id").select("incident_id", F.posexplode(ids).alias("n", "id"))
    lines = own.join(observations.filter("modality = 'log'").select("id", F.concat_ws("  ", _time("timestamp"), F.trim("log.raw")).alias("line")), "id")
    w = Window.partitionBy("incident_id")
    told = lines.withColumn("k", F.row_number().over(w.orderBy("n"))).withColumn("all", F.count("*").over(w)).filter(F.col("k") <= most)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    left = F.max("all") - most
    more = F.when(left > 0, F.concat(F.lit("\n"), left.cast("string"), F.lit(" more lines aren't shown."))).otherwise("")
    return told.groupBy("incident_id").agg(F.concat(F.lit("```\n"), joined, F.lit("\n```"), more).alias("excerpt"))


def render(incidents: DataFrame, evidence: DataFrame, changes: DataFrame, markdown: bool = False, excerpt: DataFrame | None = None) -> DataFrame:
    """(incident_id, report): title, span, services, then evidence by time and changes by time.

    ``incidents`` as of ``incident_table``, ``evidence`` as of ``evidence``, ``changes`` as of ``incident_changes``; ``excerpt``
    as of ``excerpts``, for Markdown only.
    """
    joined = evidence.join(incidents.select("incident_id", "start"), "incident_id")
    since = (F.unix_micros(F.col("first_seen").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1_000_000
    times = F.format_string("%d", "n_signals")
    score = F.format_string("%.2f", "score")
    if markdown:
        line = F.concat(F.lit("| "), F.concat_ws(" | ", signed(since), cell(F.col("source")), cell(F.col("kind")), times, score, cell(F.col("summary"))), F.lit(" |"))
        change = F.concat(F.lit("- "), F.concat_ws(" ", F.concat(F.lit("**"), cell(F.col("type")), F.lit("**")), cell(F.col("version")), cell(F.col("summary")), F.lit("at"), _time("at")))
    else:
        line = F.concat(F.lit("  "), F.concat_ws("  ", signed(since), "source", "kind", F.concat(F.lit("x"), times), score, "summary"))
        change = F.concat(F.lit("  "), F.concat_ws(" ", "type", "version", "summary", F.lit("at"), _time("at")))
    seen = _gathered(joined, line, ["first_seen", "source", "kind"], "evidence_lines")
    made = _gathered(changes, change, ["at", "type", "version"], "change_lines")
    span = humanized((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1_000_000)
    services = F.array_join("services", ", ")
    rows = incidents.join(seen, "incident_id", "left").join(made, "incident_id", "left")
    if excerpt is not None:
        rows = rows.join(excerpt, "incident_id", "left")
    none = lambda c, text: F.coalesce(F.col(c), F.lit(text))
    if markdown:
        parts = (
            F.concat(F.lit("## "), cell(F.col("title"))), F.lit(""), F.concat(F.lit("Severity "), "severity", F.format_string(", confidence %.2f, ", "confidence"), _time("start"), F.lit(", "), span, F.lit(", services: "), services),
            *(() if excerpt is None else (F.concat(F.lit("\nRaw lines around the first event:\n\n"), F.col("excerpt")),)),
            F.lit(""), F.lit("| since | source | kind | signals | score | summary |\n|---|---|---|---|---|---|"), none("evidence_lines", "| | | | | | |"), F.lit(""), none("change_lines", "No changes nearby."),
        )
    else:
        parts = (
            F.concat(F.lit("["), "severity", F.lit("] "), "title"), F.concat(_time("start"), F.lit(" for "), span, F.lit(" on "), services),
            F.lit("evidence:"), none("evidence_lines", "  none"), F.lit("changes:"), none("change_lines", "  none"),
        )
    return rows.select("incident_id", F.concat_ws("\n", *parts).alias("report"))


def debug_events(observations: DataFrame) -> DataFrame:
    """One event a row, with the observation as its only content."""
    return observations.select(
        F.substring(F.sha2(F.concat_ws("\x1f", "id", F.lit("debug")), 256), 1, 32).alias("id"), F.lit("debug.observation").alias("kind"), "source", "timestamp",
        F.lit("info").alias("severity"), F.to_json(F.struct(*observations.columns)).alias("summary"),
    )


def counted(observations: DataFrame) -> tuple[DataFrame, Observation]:
    """``observations`` of ``normalize`` with counters that are there once an action has run: ingested, accepted, rejected."""
    seen = Observation("pipeline")
    return observations.observe(
        seen, F.count("*").alias("ingested"), F.count_if(F.col("rejected").isNull()).alias("accepted"), F.count_if(F.col("rejected").isNotNull()).alias("rejected")
    ), seen
