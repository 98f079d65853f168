"""The chain end to end."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.config import load
from tidemark.operators import incidents, reports
from tidemark.operators.folds import Resume
from tidemark.plans import analysis
from tidemark.schema import CHANGE, LOG, METRIC

T0 = datetime(2026, 8, 24, 14)
ROW = f"id string, source string, service string, environment string, modality string, timestamp timestamp, ingested_at timestamp, attributes map<string, string>, log {LOG}, metric {METRIC}, change {CHANGE}"


def log(k, text, service="api"):
    return (None, None, service, "prod", "log", T0 + timedelta(seconds=k), None, None, (text, None, None, None, None, None), None, None)


def metric(k, name, value, service="api"):
    return (None, None, service, "prod", "metric", T0 + timedelta(seconds=k), None, None, None, (name, value, None), None)


def change(k, service="api"):
    return (None, None, service, "prod", "change", T0 + timedelta(seconds=k), None, None, None, None, ("deployment", "v2", None))


CONFIG = load(
    """
logs:
  detection: {learning_period: 1m}
metrics:
  detection:
    thresholds: [{metric: pool_usage_percent, max: 90}]
"""
)


def test_from_lines_to_an_incident(spark):
    rows = [log(k, f"request {k} handled in {k * 7} ms") for k in range(300)]
    rows += [log(400, "spool volume went read-only"), metric(410, "pool_usage_percent", 97.0), change(390), (None, None, None, None, "log", T0, None, None, None, None, None)]
    a = analysis.analyze(spark.createDataFrame(rows, ROW), CONFIG)
    assert a.observations.count() == 303
    assert {r["template"] for r in a.mined.filter("change_type <> 'none'").collect()} >= {"spool volume went read-only"}
    # sixty lines a minute from nothing are a burst, then the failure and the pool make one event
    events = {r["kind"]: r for r in a.events.collect()}
    assert set(events) == {"anomaly.log.frequency_spike", "anomaly.correlated"}
    last = events["anomaly.correlated"]
    assert (last["source"], last["severity"], last["n_signals"], len(last["related_changes"])) == ("prod/api", "critical", 2, 1)
    members, table = analysis.incidents_of(a.events)
    assert table.first()["severity"] == "critical" and members.count() == 2 and table.count() == 1


def test_threshold_makes_one_event(spark):
    a = analysis.analyze(spark.createDataFrame([log(0, "pool is fine"), metric(5, "pool_usage_percent", 97.0)], ROW), CONFIG)
    assert [(r["kind"], r["severity"]) for r in a.events.collect()] == [("anomaly.metric.threshold", "critical")]


def test_echo_of_another_source(spark):
    rows = [log(k, f"request {k} handled in {k * 7} ms", "kernel") for k in range(100)] + [log(130, "device eth0 entered promiscuous mode", "kernel"), change(100, "automata")]
    frame = spark.createDataFrame(rows, ROW)
    echo, *others = analysis.analyze(frame, CONFIG).events.collect()
    assert not others and (echo["kind"], echo["source"], echo["severity"]) == ("anomaly.change_echo", "prod/automata", "warning")
    assert echo["summary"] == "1 signals from 1 sources in the wake of deployment prod/automata: prod/kernel"
    assert [(c["offset_seconds"], c["version"]) for c in echo["related_changes"]] == [(-30.0, "v2")]
    assert echo["attributes"]["sources"] == "prod/kernel" and echo["attributes"]["signal_instances"] == "1"
    alone = analysis.analyze(frame.filter(F.col("modality") == "log"), CONFIG).events.collect()
    assert [(e["service"], e["environment"], len(e["before"]), len(e["after"])) for e in alone] == [("kernel", "prod", 10, 0)]
    assert analysis.incidents_of(analysis.analyze(frame, CONFIG).events)[1].count() == 1


def test_runs_that_resume(spark, tmp_path):
    """Two runs over the parts of the observations find what one run over all of them does, where nothing reaches over the cut."""
    rows = [log(k, f"request {k} handled in {k * 7} ms") for k in range(200)] + [metric(k, "lag", 5.0 + k % 3) for k in range(200)]
    rows += [log(2000, "request 9 handled in 63 ms"), log(2010, "spool volume went read-only"), metric(2020, "lag", 500.0)]
    frame = spark.createDataFrame(rows, ROW)
    early = F.col("timestamp") < F.lit(T0 + timedelta(seconds=1000))
    told = lambda a: [(r["kind"], r["ts"], r["summary"]) for r in a.signals.orderBy("ts", "kind").collect()]
    first = analysis.analyze(frame.filter(early), CONFIG, Resume(str(tmp_path / "1")))
    second = analysis.analyze(frame.filter(~early), CONFIG, Resume(str(tmp_path / "2"), str(tmp_path / "1")))
    assert told(first) + told(second) == told(analysis.analyze(frame, CONFIG))
    assert {r[0] for r in told(second)} == {"log.new_template", "metric.zscore"}
    # without rows of its own a run keeps what is known
    third = analysis.analyze(frame.limit(0), CONFIG, Resume(str(tmp_path / "3"), str(tmp_path / "2")))
    assert third.signals.count() == 0 and {spark.read.parquet(str(tmp_path / f"3/{p}")).count() for p in ("miner", "logs", "metrics")} == {1}


def test_edits_of_what_was_learned(spark, tmp_path):
    """Marks, ignored series and forgetting are made on a saved state; the next run goes by them, and hands them on."""
    from tidemark.operators import state

    at = lambda n: str(tmp_path / str(n))
    rows = [log(k, f"request {k} handled in {k * 7} ms") for k in range(40)] + [metric(k, "lag", 5.0 + k % 3) for k in range(60)]
    later = [log(2000, "request 9 handled in 63 ms"), log(2010, "spool volume went read-only"), metric(2020, "lag", 500.0)]
    early, late = spark.createDataFrame(rows, ROW), spark.createDataFrame(later, ROW)
    run = lambda frame, after, before=None: sorted(r["kind"] for r in analysis.analyze(frame, CONFIG, Resume(at(after), before and at(before))).signals.collect())
    run(early, 1)
    assert run(late, 2, 1) == ["log.new_template", "metric.zscore"]
    text = "request <NUM> handled in <NUM> ms"
    assert [(r["template"], r["size"]) for r in state.templates(spark, at(1)).collect()] == [(text, 40)]
    assert [(r["samples"], r["warmup"]) for r in state.series(spark, at(1)).collect()] == [(60, False)]
    # marked: a symptom each time it comes; ignored: no signal, though it learns
    state.mark(spark, at(1), at(3), "template", text, "symptomatic")
    assert [(r["template"], r["marking"]) for r in state.marked_templates(spark, at(3), marking="any").collect()] == [(text, "symptomatic")]
    assert run(late, 4, 3) == ["log.new_template", "log.symptomatic_template", "metric.zscore"]
    state.ignore(spark, at(4), at(5), "lag")
    again = late.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).withColumn("id", F.concat("id", F.lit("-2")))
    assert run(again, 6, 5) == ["log.symptomatic_template"] and state.series(spark, at(6)).first()["samples"] == 62
    state.mark(spark, at(6), at(7), "template", text, None)
    state.ignore(spark, at(7), at(8), "lag", False)
    assert state.part(spark, at(8), "markings").count() == state.part(spark, at(8), "ignored").count() == 0
    # forgotten: templates are new again, series warm up again
    assert state.forget_templates(spark, at(1), at(9), "spool*") == 0 and state.forget_templates(spark, at(1), at(10), "request *") == 1
    assert state.templates(spark, at(10)).count() == 0
    assert run(late, 11, 10) == ["log.new_template", "log.new_template", "metric.zscore"]
    assert state.forget_series(spark, at(1), at(12), "*/lag*") + state.forget_series(spark, at(1), at(13), "*lag*") + state.forget_series(spark, at(1), at(14), "*/*/*lag*") >= 1


def test_whole_report(spark):
    a = analysis.analyze(spark.createDataFrame([log(k, f"line | {k}") for k in range(3)] + [metric(5, "pool_usage_percent", 97.0)], ROW), CONFIG)
    members, table = analysis.incidents_of(a.events)
    signals = a.signals.crossJoin(table.select("incident_id"))  # one incident
    excerpt = reports.excerpts(a.events, members, a.observations, 2)
    text = reports.render(table, incidents.evidence(signals), reports.incident_changes(a.events, members), True, excerpt).first()["report"]
    assert "```\n2026-08-24 14:00:00  line | 0\n2026-08-24 14:00:01  line | 1\n```\n1 more lines" in text and "| metric.threshold | 1 |" in text
    head = reports.preamble(table, "2026-08-24").first()["report"]
    assert head.startswith("# Incidents\n\n## Scope\n\n- Period: since 2026-08-24\n- Incidents: 1\n") and "`metric.zscore`" in head and "None:" not in head
    assert "None: nothing" in reports.preamble(table.limit(0), glossary=False).first()["report"]
