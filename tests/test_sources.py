"""Readers, decoders, the event log and reads."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import readapi
from tidemark.sources import documents, event_log, lines


def docs(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_line_sources(spark, tmp_path):
    (tmp_path / "log").write_text('\n  \n2026-01-01T00:00:00Z app[web]: hello\n{"msg":"x","level":"warn"}\n')
    (tmp_path / "metric").write_text("# c\nup 1\nbad\n")
    (tmp_path / "change").write_text('{"time":"2026-01-01T00:00:00Z","type":"deployment","version":"1"}\nnot json\n{"type":"scale"}\n')
    all_ = lines.union(lines.log_lines(spark, str(tmp_path / "log"), "api", "prod"), lines.metric_lines(spark, str(tmp_path / "metric"), "api"), lines.change_lines(spark, str(tmp_path / "change"), "api"))
    rows = all_.collect()
    assert sorted((r["modality"], r["environment"]) for r in rows) == [("change", "default")] * 2 + [("log", "prod")] * 2 + [("metric", "default")]
    logs = {r["log"]["message"]: r for r in rows if r["log"]}
    assert logs["hello"]["attributes"] == {"log.process": "app[web]"} and logs["x"]["log"]["level"] == "warn"


def test_journal(spark):
    d = docs(
        spark, {"MESSAGE": "Failed", "PRIORITY": "3", "__REALTIME_TIMESTAMP": "1772698290700012", "_SOURCE_REALTIME_TIMESTAMP": "1772698290700001", "_SYSTEMD_UNIT": "mailer.service"},
        {"MESSAGE": [104, 105], "_SYSTEMD_UNIT": "session-c12.scope"}, {"MESSAGE": ""}, {"MESSAGE": "m", "SYSLOG_IDENTIFIER": "CRON"}, {"MESSAGE": "t", "_SYSTEMD_UNIT": ["a.timer", "b"], "_COMM": "Q"},
    )
    rows = {r["message"]: r for r in documents.journal_entries(d).select("*", F.unix_micros("timestamp").alias("us")).collect()}
    assert (rows["Failed"]["service"], rows["Failed"]["level"], rows["Failed"]["us"]) == ("mailer", "error", 1772698290700001)
    assert {m: r["service"] for m, r in rows.items()} == {"Failed": "mailer", "hi": "session", "m": "cron", "t": "a.timer b"}


def test_cluster_documents(spark):
    event = {"type": "ADDED", "object": {"metadata": {"namespace": "n"}, "type": "Warning", "reason": "BackOff", "message": "again", "lastTimestamp": "2026-01-01T00:00:00Z", "involvedObject": {"kind": "Pod", "name": "p"}}}
    row = documents.cluster_events(docs(spark, event, event | {"type": "DELETED"})).first()
    assert (row["service"], row["level"], row["message"]) == ("p", "warn", "BackOff Pod/p: again")

    def workload(generation, image="a:1", replicas=1, restarted=None):
        meta = {"annotations": {"kubectl.kubernetes.io/restartedAt": restarted}} if restarted else {}
        return {"metadata": {"uid": "u", "name": "w", "generation": generation}, "spec": {"replicas": replicas, "template": {"metadata": meta, "spec": {"containers": [{"name": "c", "image": image}]}}}}

    frames = [workload(1), workload(2, "a:2"), workload(2, "a:2"), workload(3, "a:2", restarted="now"), workload(4, "a:2", 3, "now"), workload(5, "a:2", 3, "now")]
    got = documents.workload_changes(docs(spark, *frames)).orderBy("generation").collect()
    assert [(r["type"], r["summary"]) for r in got] == [("deployment", "a:2"), ("restart", None), ("scale", "1 to 3"), ("config", None)]


def test_usage(spark):
    def stats(used, system):
        return json.dumps({"cpu_stats": {"cpu_usage": {"total_usage": used}, "system_cpu_usage": system, "online_cpus": 2}, "memory_stats": {"usage": 300, "limit": 400, "stats": {"inactive_file": 100}}})

    df = spark.createDataFrame([("c", 1, stats(100, 1000)), ("c", 2, stats(200, 1400))], "container string, ts long, stats string")
    got = documents.container_usage(df).orderBy("ts").collect()
    assert [r["cpu_percent"] for r in got] == [None, 50.0] and got[0]["memory_percent"] == 50.0
    cpu = spark.createDataFrame([("h", 1, "cpu  10 0 10 70 10 0 0 0 0 0"), ("h", 2, "cpu  40 0 10 120 30 0 0 0 0 0")], "host string, ts long, line string")
    assert [r["cpu_percent"] for r in documents.host_cpu(cpu).collect()] == [30.0]


def test_host_tables(spark):
    rows = [("h", 1, "MemTotal:  400 kB\nMemFree: 7 kB\nMemAvailable:   100 kB\n"), ("h", 2, "MemTotal: 400 kB"), ("h", 3, "MemFree: 1 kB"), ("h", 4, None)]
    memory = documents.host_memory(spark.createDataFrame(rows, "host string, ts long, text string"))
    load = documents.host_load(spark.createDataFrame([("h", 1, "1.75 0.5 0.25 1/99 7"), ("h", 2, ""), ("h", 3, None)], "host string, ts long, line string"))
    disks = documents.host_disks(spark.createDataFrame([("h", 1, "/", 1000, 250), ("h", 1, "/none", 0, 0)], "host string, ts long, path string, blocks long, available long"))
    cpu = documents.host_cpu(spark.createDataFrame([], "host string, ts long, line string"))
    got = {(r["ts"], r["name"], (r["labels"] or {}).get("path"), r["value"]) for r in documents.host_samples(cpu, memory, load, disks).collect()}
    assert got == {(1, "system.memory.used_percent", None, 75.0), (2, "system.memory.used_percent", None, 100.0), (1, "system.load1", None, 1.75), (1, "system.disk.used_percent", "/", 75.0)}


def test_resource_metrics(spark):
    at = lambda i: {"resource_id": "r", "region": "p", "resource_instance": i}
    values = {"cpu_usage_ratio": (10, 30), "memory_usage_bytes": (50, 10), "memory_limit_bytes": (100, 100), "instances_total": (2, 3), "requests_per_second": (4, 5)}
    rows = [(7, f"serverless_container_{n}", float(v), at(i)) for n, both in values.items() for i, v in zip("ab", both, strict=True)]
    got = documents.resource_metrics(spark.createDataFrame(rows, "ts long, name string, value double, labels map<string, string>")).collect()
    want = {"serverless.cpu.percent": 20.0, "serverless.memory.used_percent": 30.0, "serverless.instances": 3.0, "serverless.requests_per_second": 9.0}
    assert {r["name"]: r["value"] for r in got} == want and {(r["resource_id"], r["region"], r["ts"]) for r in got} == {("r", "p", 7)}


def test_service_of_a_sample(spark):
    df = spark.createDataFrame([({"job": "web"},), ({"job": ""},), (None,)], "labels map<string, string>")
    of = lambda *a: [r[0] for r in df.select(documents.sample_service(F.col("labels"), *a)).collect()]
    assert of("job", "query", "all") == ["web", "query", "query"] and of("job", None, "all") == ["web", "all", "all"] and of(None, None, "all") == ["all"] * 3


def test_post_again_and_drop(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    bodies = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            bodies.append(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["id"])
            self.send_response(500 if bodies[-1] == "bad" or bodies.count("shy") == 1 and bodies[-1] == "shy" else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        events = spark.createDataFrame([("good",), ("shy",), ("bad",)], "id string").coalesce(1)
        assert event_log.post(events, f"http://127.0.0.1:{server.server_port}/", attempts=2, pause_s=0.01, drop=True) == 1
    finally:
        server.shutdown()
    assert sorted(bodies) == ["bad", "bad", "good", "shy", "shy"]


def test_responses(spark):
    loki = {"status": "success", "data": {"result": [{"stream": {"a": "1"}, "values": [["1772698290700001001", "x"], ["1772698290700001001", "x"], ["1772698290700001002", '{"resource_instance":"i","message":"in"}'], ["5", '{"resource_instance":"i","message":" "}']]}]}}
    assert [r["message"] for r in documents.by_time(documents.log_responses(docs(spark, loki))).collect()] == ["x", "in"]
    vector = {"data": {"resultType": "vector", "result": [{"metric": {"job": "j"}, "value": [1772698290.5, "1.5"]}]}}
    scalar = {"data": {"resultType": "scalar", "result": [1772698290.5, "+Inf"]}}
    assert sorted(r["value"] for r in documents.metric_responses(docs(spark, vector, scalar)).collect()) == [1.5, float("inf")]


def test_routes(spark):
    df = spark.createDataFrame([("disk full", "a"), ("net down", "a"), ("x", "a")], "message string, service string")
    assert [r["service"] for r in documents.routed(df, [("disk", "storage"), ("full|net", "net")]).collect()] == ["storage", "net", "a"]


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "id string, timestamp timestamp, kind string"
    df = spark.createDataFrame([(f"e{d}", datetime(2026, 1, d, 12), "k") for d in range(1, 11)], schema)
    event_log.append(df, path, F.to_date("timestamp"))
    found = event_log.query(spark, path, schema, "2026-01-05 00:00:00", "2026-01-07 00:00:00")
    assert sorted(r["id"] for r in found.collect()) == ["e5", "e6"]
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().toString()
    assert event_log.prune(spark, path, "2026-01-03") == ["2026-01-01", "2026-01-02"]
    assert event_log.query(spark, path, schema).count() == 8
    (tmp_path / "log/day=2026-01-09/torn.json").write_text('{"id":"to')
    assert event_log.query(spark, path, schema).count() == 8
    assert json.loads(event_log.json_lines(df).first()["value"])["id"] == "e1"
    assert event_log.append_new(df.union(df), df.filter("id <> 'e1'")).count() == 1


def test_reads(spark):
    state = spark.createDataFrame([("prod/a", 1), ("prod/b", 2), ("dev/a", 3)], "partition string, n int")
    assert readapi.forget(state, "partition", "prod/*").count() == 1 and readapi.forget_counts(state, "partition", "prod/*").count() == 2
    m = readapi.mark(spark.createDataFrame([], "kind string, name string, marking string"), "template", "t", "ignore")
    assert readapi.mark(readapi.mark(m, "template", "t", "normal"), "template", "u", None).first()["marking"] == "normal"
    s = spark.createDataFrame([("a", 10.0, 1.0, 14.0), ("b", 10.0, 0.0, 50.0), ("c", 10.0, 2.0, 6.0)], "series string, mean double, std_dev double, recent double")
    assert [(r["series"], r["band"]) for r in readapi.series_by_sigma(s).collect()] == [("a", "hot"), ("c", "warm"), ("b", "calm")]
    assert readapi.containing(state, ["partition"], "DEV").count() == 1


def test_polling_source(spark, tmp_path):
    from tidemark.sources import polling

    class Numbers:
        """Gives the numbers from the offset on, three at most at once."""

        def __init__(self, options):
            self.upto = int(options.get("upto", "5"))

        def read(self, offset):
            end = min(self.upto, offset + 3)
            return [(k, f"n{k}") for k in range(offset, end)], end

    polling.register(spark, "numbers", "n long, text string", Numbers)
    assert [r["n"] for r in spark.read.format("numbers").load().collect()] == [0, 1, 2]
    q = spark.readStream.format("numbers").load().writeStream.format("memory").queryName("numbers").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["n"] for r in spark.table("numbers").collect()) == [0, 1, 2, 3, 4]


def test_partitioned_source_is_read_by_tasks(spark, tmp_path):
    """Partitions with string cursors, read by tasks over restarts; new ones are taken up, and one whose cursor has expired is listed again."""
    import os

    from tidemark.sources import polling

    class Journals:
        def __init__(self, options):
            self.folder = options["folder"]

        def partitions(self):
            return sorted(os.listdir(self.folder))

        def _entries(self, partition):
            with open(f"{self.folder}/{partition}") as f:
                return [line.split() for line in f]

        def latest(self, partition):
            return next((cursor for cursor, _ in reversed(self._entries(partition))), None)

        def read(self, partition, after, until):
            entries = self._entries(partition)
            cursors = [c for c, _ in entries]
            if after is not None and after not in cursors:
                raise polling.Expired
            begin = 0 if after is None else cursors.index(after) + 1
            for cursor, text in entries[begin : cursors.index(until) + 1]:
                yield partition, cursor, text, os.getpid()

    def put(name, mode, *entries):
        with open(folder / name, mode) as f:
            f.writelines(f"{c} {t}\n" for c, t in entries)

    folder, out = tmp_path / "journals", str(tmp_path / "out")
    folder.mkdir()
    polling.register(spark, "journals", "unit string, cursor string, text string, pid int", Journals)

    def run():
        stream = spark.readStream.format("journals").option("folder", str(folder)).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        rows = spark.read.parquet(out).collect()
        assert os.getpid() not in {r["pid"] for r in rows}
        return sorted((r["unit"], r["cursor"], r["text"]) for r in rows)

    put("a", "w", ("s=a;i=1", "one"), ("s=a;i=2", "two"))
    put("b", "w", ("s=b;i=9", "nine"))
    put("empty", "w")
    assert run() == [("a", "s=a;i=1", "one"), ("a", "s=a;i=2", "two"), ("b", "s=b;i=9", "nine")]
    put("a", "a", ("s=a;i=3", "three"))
    put("c", "w", ("s=c;i=1", "new"))
    assert run()[2:] == [("a", "s=a;i=3", "three"), ("b", "s=b;i=9", "nine"), ("c", "s=c;i=1", "new")]
    put("b", "w", ("s=b;i=20", "twenty"), ("s=b;i=21", "more"))  # rotated: the cursor of nine is gone
    assert [r for r in run() if r[0] == "b"] == [("b", "s=b;i=20", "twenty"), ("b", "s=b;i=21", "more"), ("b", "s=b;i=9", "nine")]
    batch = spark.read.format("journals").option("folder", str(folder)).load()
    assert batch.rdd.getNumPartitions() == 3 and batch.count() == 6


def test_container_rows(spark):
    df = spark.createDataFrame([("web.1", "web"), ("web.1.upcoming-12", "web"), ("tidemark-x", "own")], "name string, service string")
    assert documents.excluded(df, ["name"], ["tidemark*"]).count() == 2 and documents.measured(df).count() == 2
    assert {r["service"]: r["running"] for r in documents.running_counts(df).collect()} == {"web": 2, "own": 1}
    labels = F.create_map(F.lit("app"), F.lit(""))
    s = spark.range(1).select(documents.owner_service(labels, ["app"], F.lit("ReplicaSet"), F.lit("api-5d8f"), F.lit("p")), documents.container_service(labels, "app", F.lit("/blog.web.1"))).first()
    assert tuple(s) == ("api", "blog")


def test_listings(spark):
    t = spark.createDataFrame([("prod/a", "1", "x <*>", 5), ("prod/b", "1", "y", 9)], "source string, template_id string, template string, size long")
    m = spark.createDataFrame([("template", "y", "ignore")], "kind string, name string, marking string")
    assert [(r["template"], r["marking"]) for r in readapi.template_rows(t, m).collect()] == [("y", "ignore"), ("x <*>", None)]
    assert [r["template"] for r in readapi.template_rows(t, m, "PROD/A").collect()] == ["x <*>"] and readapi.template_rows(t, m, marking="any").count() == 1
    s = spark.createDataFrame([("w", 1, 0.0, 0.0, 9.0, True), ("flat", 99, 1.0, 0.0, 2.0, False), ("z", 99, 1.0, 1.0, 3.0, False)], "series string, samples long, mean double, std_dev double, recent double, warmup boolean")
    assert [r["series"] for r in readapi.series_rows(s).collect()] == ["flat", "z", "w"]
    assert tuple(readapi.empty_state(t, t, s).first()) == (2, 2, 1)
