"""Windows, severity, changes, echoes and incidents."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import correlate, incidents

T0 = datetime(2026, 8, 24, 14, 5)
SIGNAL = "source string, seq long, ts timestamp, kind string, modality string, score double, merge_key string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def signals(spark, rows):
    return spark.createDataFrame([(s, k, at(t), kind, kind.split(".")[0], score, kind) for k, (s, t, kind, score) in enumerate(rows)], SIGNAL)


def test_anchored_windows(spark):
    df = signals(spark, [("a", 0, "log.new_template", 0.5), ("a", 20, "log.new_template", 0.5), ("a", 29, "x.y", 0.5), ("a", 30, "x.y", 0.5), ("b", 10, "x.y", 0.5)])
    got = correlate.anchored_windows(df).groupBy("source", "window_us").count().collect()
    assert sorted((r["source"], r["count"]) for r in got) == [("a", 1), ("a", 3), ("b", 1)]


SEVERITIES = [
    (0.99, False, False, False, False, "warning"), (0.99, True, False, True, False, "critical"), (0.99, False, True, False, False, "warning"), (0.99, False, True, True, False, "critical"),
    (0.9, False, False, False, True, "critical"), (0.9, False, False, True, False, "warning"), (0.7, True, False, True, False, "warning"), (0.4, False, False, False, False, "info"),
]


@pytest.mark.parametrize("conf, multi, change, log, asked, want", SEVERITIES)
def test_severity(spark, conf, multi, change, log, asked, want):
    row = spark.range(1).select(correlate.severity(F.lit(conf), F.lit(multi), F.lit(change), F.lit(log), F.lit(asked)).alias("s")).first()
    assert row["s"] == want


def test_merge_and_combine(spark):
    df = signals(spark, [("a", 0, "log.new_template", 0.8), ("a", 1, "log.new_template", 0.8), ("a", 2, "metric.zscore", 0.5), ("a", 3, "metric.zscore", 0.6)])
    row = correlate.combine(correlate.merge_signals(df, ["source"]), ["source"]).first()
    assert row["confidence"] == pytest.approx(1 - 0.2 * 0.4) and row["multimodal"]
    assert [(s["kind"], s["score"], s["occurrences"]) for s in row["signals"]] == [("log.new_template", 0.8, 2), ("metric.zscore", 0.6, 2)]
    many = signals(spark, [("a", 0, f"k.{k}", 0.9) for k in range(5)])
    assert correlate.combine(correlate.merge_signals(many, ["source"]), ["source"]).first()["confidence"] == 0.99


def test_related_changes_at_the_edges(spark):
    events = spark.createDataFrame([("e", "a", at(0))], "event_id string, source string, ts timestamp")
    changes = spark.createDataFrame([("a", k, at(t)) for k, t in enumerate((-901, -900, -1, 30, 31))] + [("b", 9, at(0))], "source string, change_id long, ts timestamp")
    assert sorted(r["change_id"] for r in correlate.related_changes(events, changes).collect()) == [1, 2, 3]


@pytest.mark.parametrize("horizon, window", [(86400, 30), (900, 3600), (0, 0), (7, 0.5)])
def test_related_changes_over_long_horizons(spark, horizon, window):
    """Every pair once, to the microsecond, in few rows: no row is spread over more slots of time than three, and no side goes through the driver."""
    rng = random.Random(horizon)
    span = round((horizon + window) * 1_000_000) or 1
    start = 1_790_000_000_000_000 // span * span  # where a slot begins
    places = [start + k * span + d for k in range(4) for d in (-1, 0, 1)] + [start + rng.randrange(4 * span) for _ in range(30)]
    e = [(k, s, t) for k, (s, t) in enumerate((s, t) for s in "ab" for t in places)]
    near = [t + d for t in places for d in (0, round(-horizon * 1e6), round(-horizon * 1e6) - 1, round(window * 1e6), round(window * 1e6) + 1)]
    c = [(k, s, t) for k, (s, t) in enumerate((s, t) for s in "ac" for t in near)]
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, source string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    found = correlate.related_changes(table(e, "event_id"), table(c, "change_id"), horizon, window)
    want = sorted((i, j, round((u - t) / 1e6, 6)) for i, s, t in e for j, r, u in c if s == r and -horizon * 1_000_000 <= u - t <= window * 1_000_000)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString()
    spread, nodes = [], [plan.optimizedPlan()]
    for node in nodes:
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Generate":
            spread.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node).count())
    assert len(spread) == 1 and spread[0] <= 3 * max(len(e), len(c))


def test_echoes(spark):
    s = signals(spark, [("kernel", 30, "log.new_template", 0.8), ("host", 40, "metric.threshold", 0.9), ("own", 50, "log.new_template", 0.8), ("late", 700, "log.new_template", 0.8), ("udevd", 35, "metric.zscore", 0.7)])
    changes = spark.createDataFrame([("own", 1, at(0)), ("zz", 2, at(0)), ("other", 3, at(20))], "source string, change_id long, ts timestamp")
    got = {r["seq"]: (r["change_id"], r["delay_seconds"]) for r in correlate.echoes(s, changes).collect()}
    assert got == {0: (3, 10.0), 4: (3, 15.0)}


def test_echoes_by_brute_force(spark):
    """Many changes at the same moments and slots, against all pairs."""
    import random

    rng = random.Random(9)
    rows = [(f"s{rng.randrange(5)}", rng.randrange(0, 4000), rng.choice(("log.new_template", "metric.threshold", "metric.zscore")), 0.8) for _ in range(200)]
    made = [(f"s{rng.randrange(5)}", k, 20 * rng.randrange(0, 200)) for k in range(30)]
    changes = spark.createDataFrame([(s, k, at(t)) for s, k, t in made], "source string, change_id long, ts timestamp")
    want = {}
    for seq, (source, t, kind, _) in enumerate(rows):
        if kind == "metric.threshold" or any(s == source and 0 <= t - c <= 100 for s, _, c in made):
            continue
        found = min(((t - c, s, k) for s, k, c in made if s != source and 0 <= t - c <= 60), default=None)
        if found:
            want[seq] = (found[2], found[1], float(found[0]))
    got = {r["seq"]: (r["change_id"], r["echo_source"], r["delay_seconds"]) for r in correlate.echoes(signals(spark, rows), changes, 100, 60).collect()}
    assert got == want and want


def test_echo_events(spark):
    s = signals(spark, [("kernel", 30, "log.new_template", 0.8), ("udevd", 35, "log.new_template", 0.95), ("udevd", 36, "log.new_template", 0.9), ("far", 2000, "x.y", 0.5)])
    changes = spark.createDataFrame([("app", 1, at(0), "deployment"), ("app", 2, at(20), "restart"), ("app", 3, at(1990), "scale")], "source string, change_id long, ts timestamp, type string")
    first, second = sorted(correlate.echo_events(s, changes).collect(), key=lambda r: r["ts"])
    assert (first["kind"], first["source"], first["ts"], first["severity"], first["n_signals"]) == ("anomaly.change_echo", "app", at(30), "warning", 2)
    assert first["confidence"] == pytest.approx(0.99) and first["summary"] == "2 signals from 2 sources in the wake of restart app: kernel, udevd"
    assert [(c["change_id"], c["offset_seconds"]) for c in first["related_changes"]] == [(1, -30.0), (2, -10.0)]
    assert first["attributes"] == {"signal_count": "2", "signal_instances": "3", "multimodal": "false", "sources": "kernel,udevd"}
    assert (second["severity"], second["n_signals"], [c["change_id"] for c in second["related_changes"]]) == ("info", 1, [3])


def test_events_name_the_latest_changes(spark):
    s = signals(spark, [("a", 0, "log.new_template", 0.8)])
    changes = spark.createDataFrame([("a", k, at(-k)) for k in range(100)], "source string, change_id long, ts timestamp")
    assert [c["change_id"] for c in correlate.build_events(s, changes).first()["related_changes"]] == list(range(63, -1, -1))


def test_context(spark):
    rows = spark.createDataFrame([("a", k, at(k)) for k in range(15)], "source string, seq long, ts timestamp")
    got = {r["seq"]: (r["before"], r["after"]) for r in correlate.context(rows, 3, 2).collect()}
    assert got[10] == ([8, 9, 10], [11, 12]) and got[0] == ([0], [1, 2]) and got[14] == ([12, 13, 14], [])


def test_events(spark):
    s = signals(spark, [("a", 0, "log.new_template", 0.8), ("a", 5, "metric.zscore", 0.8), ("b", 0, "metric.zscore", 0.95)])
    changes = spark.createDataFrame([("a", 1, at(-60))], "source string, change_id long, ts timestamp")
    got = {r["source"]: r for r in correlate.build_events(s, changes).collect()}
    assert (got["a"]["kind"], got["a"]["severity"], got["a"]["n_signals"]) == ("anomaly.correlated", "critical", 2)
    assert (got["b"]["kind"], got["b"]["severity"], got["b"]["related_changes"]) == ("anomaly.metric.zscore", "warning", None)


def events(spark, rows):
    schema = "event_id string, ts timestamp, service string, change_keys array<string>, severity string, confidence double, summary string"
    return spark.createDataFrame([(i, at(t), s, c, sev, conf, text) for i, t, s, c, sev, conf, text in rows], schema)


def test_incidents(spark):
    rows = [
        ("old", -86400, "blog", None, "warning", 0.5, "rare log template: disk almost full"),
        ("trigger", 0, "checkout", ["v1.8.2"], "critical", 0.92, "new log template: timeout (+1 correlated signals)"),
        ("spread", 120, "payment", ["v1.8.2"], "warning", 0.8, "pool usage = 97"),
    ]
    df = events(spark, rows)
    members = incidents.group_events(df)
    assert {r["event_id"]: r["incident_id"] for r in members.collect()} == {"old": "old", "trigger": "trigger", "spread": "trigger"}
    got = incidents.incident_list(incidents.incident_table(df, members), least="critical").collect()
    assert [(r["incident_id"], r["severity"], r["confidence"], r["services"], r["n_events"], r["title"]) for r in got] == [
        ("trigger", "critical", 0.92, ["checkout", "payment"], 2, "checkout: new log template: timeout (+1 service)")
    ]


def test_chronic_service_is_split(spark):
    df = events(spark, [(f"e{k:02}", 600 * k, "s", None, "info", 0.5, "x") for k in range(40)])
    sizes = incidents.group_events(df).groupBy("incident_id").count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) <= 7


def test_islands_equal_one_fold(spark):
    """Islands of time give what one fold over all events gives."""
    import random

    rng = random.Random(4)
    t, rows = 0, []
    for k in range(300):
        t += rng.choice((5, 40, 600, 1799, 1801, 4000, 9000))
        rows.append((f"e{k:03}", t, f"s{rng.randrange(4)}", [f"c{rng.randrange(6)}"] if rng.random() < 0.3 else None, "info", 0.5, "x"))
    fold = incidents.Grouping()
    want = dict(x for i, ts, s, c, *_ in rows for x in fold.step(i, i, ts * 1_000_000, ts * 1_000_000, s, c))
    assert {r["event_id"]: r["incident_id"] for r in incidents.group_events(events(spark, rows)).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_incidents_of_a_stream_without_pause(spark, seed):
    """Hours of events that follow each other closely, equal times among them, as one fold has them; few pieces stand for many events."""
    import random

    rng = random.Random(seed)
    t, rows = 0.0, []
    for k in range(3000):
        t += rng.choice((0, 0, 1, 10, 29, 30, 30)) if rng.random() < 0.985 else rng.choice((30.5, 31, 200, 1500, 1900))
        rows.append((f"e{rng.randrange(10)}{k:05}", t, f"s{rng.randrange(5)}", [f"c{rng.randrange(9)}"] if rng.random() < 0.1 else None, "info", 0.5, "x"))
    rows.sort(key=lambda r: (r[1], r[0]))
    fold = incidents.Grouping()
    want = dict(x for i, ts, s, c, *_ in rows for x in fold.step(i, i, int(ts * 1_000_000), int(ts * 1_000_000), s, c))
    df = events(spark, rows)
    assert {r["event_id"]: r["incident_id"] for r in incidents.group_events(df).collect()} == want
    assert len(set(want.values())) > 12
    heads = incidents._heads(df.select("event_id", F.unix_micros("ts").alias("us")), incidents.GroupConfig())
    assert 0 < heads.filter("head").count() < 400


def test_evidence_last_of_equals(spark):
    rows = [("i", "k", "s", 0.8, "first", at(0), 0), ("i", "k", "s", 0.8, "second", at(5), 1), ("i", "k", "s", 0.3, "third", at(9), 2)]
    got = incidents.evidence(spark.createDataFrame(rows, "incident_id string, kind string, source string, score double, summary string, ts timestamp, seq long")).first()
    assert (got["summary"], got["n_signals"], got["score"]) == ("second", 3, 0.8)


def test_reports(spark):
    from tidemark.operators import reports

    df = events(spark, [("e1", 0, "checkout", None, "critical", 0.9, "timeout"), ("e2", 63, "pay|ment", None, "warning", 0.7, "slow")])
    members = incidents.group_events(df.withColumn("change_keys", F.array(F.lit("c"))))
    table = incidents.incident_table(df, members)
    own = df.join(members, "event_id").select("incident_id", F.lit("log.new_template").alias("kind"), F.col("service").alias("source"), F.col("confidence").alias("score"), "summary", "ts", F.lit(0).alias("seq"))
    change = F.array(F.struct(F.lit("deployment").alias("type"), F.lit("v1").alias("version"), F.lit(None).cast("string").alias("summary"), F.lit(-60.0).alias("offset_seconds")))
    changes = reports.incident_changes(df.withColumn("related_changes", change), members)
    assert [(r["type"], r["at"]) for r in changes.collect()] == [("deployment", at(-60))]
    text = reports.render(table, incidents.evidence(own), changes).first()["report"]
    assert text.splitlines()[0] == "[critical] checkout: timeout (+1 service)" and "  +1m 3s  pay|ment" in text and "deployment v1 at 2026-08-24 14:04:00" in text
    assert "| +1m 3s | pay\\|ment |" in reports.render(table, incidents.evidence(own), changes, markdown=True).first()["report"]
