"""Streams give what batches give, over a restart as well."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import correlate, incidents, metric_detector, mining
from tidemark.operators.mining import MinerConfig
from tidemark.sources import event_log
from tidemark.streaming import correlation, queries
from tidemark.streaming.folds import PROVIDER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def provider(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # each has a state store of its own
    yield
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def samples(df):
    return df.select("event_id", "ts", "value", F.lit("value").alias("metric"), F.concat(F.lit("prod/"), "event_type").alias("series"))


def test_metric_stream_equals_batch_over_a_restart(spark, provider, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(source)
        q = queries.metric_judgements(samples(stream)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out)
        q.trigger(availableNow=True).start().awaitTermination(120)

    events.filter("event_id < 600").coalesce(1).write.mode("append").parquet(source)
    run()
    events.filter("event_id >= 600").coalesce(1).write.mode("append").parquet(source)
    run()
    want = metric_detector.judge(samples(events))
    got = spark.read.parquet(out).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_metric_stream_knows_limits_and_ignored_series(spark, provider, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    how = {"rules": {"value": (100.0, 1.0)}, "ignored": ["prod/sign*"]}
    stream = samples(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = queries.metric_judgements(stream, **how, ttl_s=3600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
    q.trigger(availableNow=True).start().awaitTermination(120)
    want = metric_detector.judge(samples(events), **how)
    got = spark.read.parquet(str(tmp_path / "out")).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    found = metric_detector.signals(got).filter(F.col("kind") == metric_detector.THRESHOLD).select("series").distinct()
    assert {r[0] for r in found.collect()} and not any(r[0].startswith("prod/sign") for r in found.collect())


def test_events_of_streams_equal_those_of_batches(spark, provider, tmp_path):
    """Over a restart amid open windows; ticks close the last ones."""
    e = spark.read.parquet(f"{SF}/events.parquet").select(
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("source"), F.col("event_id").alias("seq"), "event_type", F.timestamp_seconds(F.col("event_id") * 7).alias("ts"), "value"
    )
    kind = F.when(F.col("value") > 60, "log.rare_template").otherwise("metric.zscore")
    signals = e.filter("event_type = 'error'").select("source", "seq", "ts", kind.alias("kind"), F.split(kind, "[.]")[0].alias("modality"), F.lit(0.6).alias("score"), kind.alias("merge_key"), F.lit("x").alias("summary"))
    changes = e.filter("event_type = 'signup'").select("source", F.col("seq").alias("change_id"), "ts", F.lit("deployment").alias("type"))
    ticks = e.groupBy("source").agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    path, half = str(tmp_path / "log"), F.timestamp_seconds(F.lit(500 * 7))
    frames = {"signals": signals, "changes": changes, "ticks": ticks}
    for part in (F.col("ts") < half, F.col("ts") >= half):
        for name, df in frames.items():
            df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = {name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for name, df in frames.items()}
        correlation.events_to_log(streams["signals"], streams["changes"], path, str(tmp_path / "cp"), streams["ticks"], horizon_s=600).awaitTermination(120)
    want = correlate.build_events(signals, changes, horizon_s=600).withColumnRenamed("event_id", "id")
    got = event_log.query(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in want.schema))
    told = lambda df: sorted((r["id"], r["kind"], r["severity"], r["n_signals"], r["summary"], [c["change_id"] for c in r["related_changes"] or ()]) for r in df.collect())
    assert told(got) == told(want) and any(x[-1] for x in told(want)) and len({x[3] for x in told(want)}) > 1


def stamped(spark, rows, schema):
    """rows begin with (source, second)."""
    return spark.createDataFrame([(r[0], r[1], *r[2:]) for r in rows], f"source string, s double, {schema}").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")


SIGNAL = "seq long, kind string, modality string, score double, merge_key string"


def signal(source, s, seq):
    return source, float(s), seq, "metric.zscore", "metric", 0.5, f"k{seq % 3}"


def played(spark, tmp_path, parts, start):
    """Each part's rows arrive, and all there is is taken; ``start`` gets the streams by name."""
    for part in parts:
        for name, df in part.items():
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = {name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for name, df in part.items()}
        query = start(**streams)
        query.awaitTermination(180)
        assert query.exception() is None


def test_a_silent_source_closes_by_the_watermark(spark, provider, tmp_path):
    """The last window comes out because another source goes on, without a later row of its own; nothing comes before its time."""
    changes = stamped(spark, [("a", 990.0, 7)], "change_id long")
    ticks = lambda *at: stamped(spark, [("b", float(s), 0) for s in at], "n long").drop("n")
    none = stamped(spark, [], SIGNAL)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(signals, changes, ticks):
        rows = correlation.closed(signals, changes, ticks, late="5 seconds")
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()

    def seen():
        return [(r["source"], r["start_us"] // 1_000_000, len(r["signals"]), len(r["changes"])) for r in spark.read.parquet(out).orderBy("start_us").collect()]

    first = {"signals": stamped(spark, [signal("a", 1000, 1), signal("a", 1029, 2), signal("a", 1031, 3)], SIGNAL), "changes": changes, "ticks": ticks(1010)}
    played(spark, tmp_path, [first], start)
    assert seen() == []  # the watermark stands at 1026
    played(spark, tmp_path, [{"signals": none, "changes": changes.limit(0), "ticks": ticks(1040)}], start)
    assert seen() == [("a", 1000, 2, 1)]
    played(spark, tmp_path, [{"signals": none, "changes": changes.limit(0), "ticks": ticks(1070)}], start)
    assert seen() == [("a", 1000, 2, 1), ("a", 1031, 1, 1)]


def test_a_silent_source_closes_by_the_wall_clock(spark, provider, tmp_path):
    """By the machine's clock a window closes though nothing comes of any source; what came within it is in it, whatever its time."""
    changes = stamped(spark, [("a", 990.0, 7)], "change_id long")
    signals = stamped(spark, [signal("a", 1000, 1), signal("a", 5000, 2)], SIGNAL)
    signals.coalesce(1).write.parquet(str(tmp_path / "signals"))
    changes.coalesce(1).write.parquet(str(tmp_path / "changes"))
    streams = {n: spark.readStream.schema(df.schema).parquet(str(tmp_path / n)) for n, df in {"signals": signals, "changes": changes}.items()}
    query = correlation.events_to_log(**streams, path=str(tmp_path / "log"), checkpoint=str(tmp_path / "cp"), window_s=2, clock=correlation.WALL, processingTime="1 second")
    try:
        found = []
        for _ in range(60):
            time.sleep(1)
            if list((tmp_path / "log").glob("*/*")):
                found = event_log.query(spark, str(tmp_path / "log"), "id string, source string, n_signals long, related_changes array<struct<change_id:long>>").collect()
                if found:
                    break
    finally:
        query.stop()
    assert [(r["source"], r["n_signals"], [c["change_id"] for c in r["related_changes"]]) for r in found] == [("a", 2, [7])]
    with pytest.raises(ValueError):
        correlation.closed(**streams, echo_s=5, clock=correlation.WALL)


def test_echoes_of_streams_equal_those_of_batches(spark, provider, tmp_path):
    """Changes reach signals of all sources, over a restart and amid open sessions; rows come in any order."""
    rng = random.Random(8)
    signals = stamped(spark, [signal(rng.choice("abcde"), rng.randrange(0, 40_000) / 2, k) for k in range(400)], SIGNAL).withColumn("summary", F.lit("x"))
    signals = signals.withColumn("kind", F.when(F.col("seq") % 11 == 0, "metric.threshold").otherwise(F.col("kind")))
    changes = stamped(spark, [(rng.choice("abc"), rng.randrange(0, 40_000) / 2, k) for k in range(60)], "change_id long").withColumn("type", F.lit("deployment"))
    ticks = stamped(spark, [("z", 90_000.0, 0)], "n long").drop("n")
    how = {"horizon_s": 300, "echo_s": 200}
    half = F.timestamp_seconds(F.lit(10_000))
    parts = [{"signals": signals.filter(F.col("ts") < half), "changes": changes.filter(F.col("ts") < half), "ticks": ticks.limit(0)},
             {"signals": signals.filter(F.col("ts") >= half), "changes": changes.filter(F.col("ts") >= half), "ticks": ticks}]
    path = str(tmp_path / "log")
    played(spark, tmp_path, parts, lambda **s: correlation.events_to_log(**s, path=path, checkpoint=str(tmp_path / "cp"), **how))
    echoed = correlate.echoes(signals, changes, **how).select("seq")
    want = correlate.build_events(signals.join(echoed, "seq", "left_anti"), changes, horizon_s=300).unionByName(correlate.echo_events(signals, changes, **how), allowMissingColumns=True)
    want = want.withColumnRenamed("event_id", "id")
    got = event_log.query(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in want.schema))
    told = lambda df: sorted((r["id"], r["kind"], r["source"], r["severity"], round(r["confidence"], 9), r["n_signals"], r["summary"], tuple(c["change_id"] for c in r["related_changes"] or ())) for r in df.collect())
    assert told(got) == told(want)
    kinds = [x[1] for x in told(want)]
    assert kinds.count("anomaly.change_echo") > 20 and len(kinds) - kinds.count("anomaly.change_echo") > 50


def test_incidents_of_streams_equal_those_of_batches(spark, provider, tmp_path):
    rng = random.Random(9)
    t, rows = 0, []
    for k in range(300):
        t += rng.choice((0, 5, 20, 40, 600, 1799, 1801, 4000))
        rows.append((f"s{rng.randrange(4)}", float(t), f"e{k:03}", [f"c{rng.randrange(6)}"] if rng.random() < 0.3 else None))
    rows = stamped(spark, rows, "event_id string, change_keys array<string>").withColumnRenamed("source", "service")
    last = stamped(spark, [("s9", t + 50_000.0, "last", None)], "event_id string, change_keys array<string>").withColumnRenamed("source", "service")
    half = F.timestamp_seconds(F.lit(t // 2))
    out = str(tmp_path / "out")

    def start(events):
        return correlation.incident_members(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    played(spark, tmp_path, [{"events": rows.filter(F.col("ts") < half)}, {"events": rows.filter(F.col("ts") >= half)}, {"events": last}], start)
    got = spark.read.parquet(out).collect()
    want = {r["event_id"]: r["incident_id"] for r in incidents.group_events(rows).collect()}
    assert {r["event_id"]: r["incident_id"] for r in got if not r["closed"]} == want
    assert sorted(r["incident_id"] for r in got if r["closed"]) == sorted(set(want.values()))  # each retires once


def test_event_log_batch_again(spark, tmp_path):
    """A batch that comes again, as after a failure before its commit, is there once, beside others; the half of one is made whole."""
    df = spark.createDataFrame([("a", "2026-08-24T10:00:00Z", 1), ("b", "2026-08-25T10:00:00Z", 1), ("c", "2026-08-25T11:00:00Z", 2)], "id string, timestamp string, part int")
    df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    path = str(tmp_path / "log")
    df.filter("part = 1").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    queries.to_event_log(stream, path, str(tmp_path / "cp")).awaitTermination(120)
    df.filter("part = 2").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for again in ("cp", "cp2"):  # a new checkpoint runs all batches again
        queries.to_event_log(stream, path, str(tmp_path / again)).awaitTermination(120)
    schema = "id string, timestamp timestamp"
    assert sorted(r["id"] for r in event_log.query(spark, path, schema).collect()) == ["a", "b", "c"]
    assert sorted(r["id"] for r in event_log.query(spark, path, schema, since="2026-08-25").collect()) == ["b", "c"]


def test_bucket_counts_close_with_the_watermark(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.lit("s").alias("source"), F.col("event_type").alias("template_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = queries.bucket_counts(stream, "1 day").writeStream.format("memory").queryName("buckets").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = rows.agg(F.max(F.date_trunc("day", "ts"))).first()[0]
    want = rows.groupBy("template_id", F.date_trunc("day", "ts").alias("bucket")).count().filter(F.col("bucket") < F.lit(last))
    assert spark.table("buckets").agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0]


def test_stream_to_event_log(spark, tmp_path):
    df = spark.createDataFrame([("a", "k"), ("a", "k"), ("b", "k")], "id string, kind string")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    for _ in range(2):
        queries.to_event_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert event_log.query(spark, str(tmp_path / "log"), "id string, kind string").count() == 2


def test_live_events(spark, provider, tmp_path):
    """The newest, oldest first, a marker, then what follows; what comes again over micro-batches is told once."""
    from tidemark.streaming import live

    batch = lambda *seconds: spark.createDataFrame([(f"e{s:03}", s) for s in seconds], "id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = str(tmp_path / "out")

    def start(events):
        return live.live(events, 10).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    played(spark, tmp_path, [{"events": batch(*range(60), 55, 56)}, {"events": batch(59, 61, 60, 61)}, {"events": batch(58, 61, 62)}], start)
    rows = sorted((r["n"], r["what"], r["id"]) for r in spark.read.parquet(out).collect())
    want = [(live.RECENT, f"e{s:03}") for s in range(50, 60)] + [(live.MARKER, None)] + [(live.LIVE, f"e{s:03}") for s in (60, 61, 62)]
    assert rows == [(n, *x) for n, x in enumerate(want)]


def test_mined_stream_equals_batch_over_a_restart(spark, provider, tmp_path):
    """The miner's nested state goes through the state store, where Spark's reader shows it."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, f"{rng.choice(['open', 'close', 'read'])} {rng.choice(['x', 'y', 'z', 'w1'])} {rng.choice(['by', 'of'])} " + "q " * rng.randrange(3)) for k in range(300)]
    lines = spark.createDataFrame(rows, "source string, seq long, message string").withColumn("ts", F.timestamp_seconds("seq"))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(lines):
        return queries.mined(lines, MinerConfig(max_clusters=6)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()

    played(spark, tmp_path, [{"lines": lines.filter("seq < 130")}, {"lines": lines.filter("seq >= 130")}], start)
    want = mining.mine(lines, ["ts", "seq"], "seq", MinerConfig(max_clusters=6)).select("source", "seq", "template_id", "template", "change_type", "cluster_size")
    got = spark.read.parquet(out).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.filter("template_id > 6").count()
    stored = spark.read.format("statestore").option("stateVarName", "fold").load(cp)
    assert {len(r[0]) for r in stored.select("value.clusters").collect()} == {6}
