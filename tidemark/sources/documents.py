"""Decoders of JSON documents that agents and APIs give, a text column of one document a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.templates import path_glob
from tidemark.functions.text import level_of, time_of

#: Endings of unit names, and units that come and go, with the name that stands for them.
UNIT_ENDS = ("service", "socket", "scope", "mount", "timer")
TRANSIENT_UNITS = (
    (r"^session-c?[0-9]+$", "session"),
    (r"^user@[0-9]+$", "user"),
    (r"^user-[0-9]+$", "user"),
    (r"^run-user-[0-9]+$", "run-user"),
    (r"^docker-[0-9a-f]{12,}$", "docker"),
    (r"^run-docker-netns-[0-9a-f]+$", "run-docker-netns"),
    (r"^systemd-fsck@.+$", "systemd-fsck"),
)


def _field(doc: Column, name: str) -> Column:
    """A string as it is, an array of byte values as text, an array of strings joined by spaces."""
    text = F.get_json_object(doc, f"$.{name}")
    numbers = F.transform(F.from_json(text, "array<int>"), lambda b: F.lpad(F.hex(b), 2, "0"))
    words = F.array_join(F.from_json(text, "array<string>"), " ")
    return (
        F.when(text.rlike(r"^\[\s*-?\d"), F.decode(F.unhex(F.array_join(numbers, "")), "utf-8")).when(text.startswith("["), words).otherwise(text)
    )


def unit_service(unit: Column, identifier: Column, command: Column) -> Column:
    """The unit without its ending, transient units under one name; without a unit, the identifier or command."""
    name = F.regexp_replace(unit, rf"\.({'|'.join(UNIT_ENDS)})$", "")
    for pattern, stands_for in TRANSIENT_UNITS:
        name = F.when(name.rlike(pattern), stands_for).otherwise(name)
    full = lambda c: F.when(c != "", c)
    return F.coalesce(full(name), full(F.lower(identifier)), full(F.lower(command)))


def journal_entries(docs: DataFrame, doc: str = "value") -> DataFrame:
    """(message, service, level, timestamp, host, cursor) of journal export documents; those without a message go."""
    d = F.col(doc)
    at = F.coalesce(*[_field(d, f).try_cast("bigint") for f in ("_SOURCE_REALTIME_TIMESTAMP", "__REALTIME_TIMESTAMP")])
    return docs.select(
        _field(d, "MESSAGE").alias("message"),
        unit_service(_field(d, "_SYSTEMD_UNIT"), _field(d, "SYSLOG_IDENTIFIER"), _field(d, "_COMM")).alias("service"),
        _field(d, "SYSLOG_IDENTIFIER").alias("identifier"),
        level_of(_field(d, "PRIORITY")).alias("level"),
        F.timestamp_micros(at).alias("timestamp"),
        _field(d, "_HOSTNAME").alias("host"),
        _field(d, "__CURSOR").alias("cursor"),
    ).filter(F.coalesce(F.trim("message"), F.lit("")) != "")


def cluster_events(docs: DataFrame, doc: str = "value") -> DataFrame:
    """(service, namespace, message, level, timestamp) of event watch frames that add or modify."""
    g = lambda path: F.get_json_object(doc, f"$.object.{path}")
    at = F.coalesce(*[time_of(g(p)) for p in ("lastTimestamp", "eventTime", "metadata.creationTimestamp")])
    return docs.filter(F.get_json_object(doc, "$.type").isin("ADDED", "MODIFIED")).select(
        g("involvedObject.name").alias("service"),
        g("metadata.namespace").alias("namespace"),
        F.concat_ws(": ", F.concat_ws(" ", g("reason"), F.concat(g("involvedObject.kind"), F.lit("/"), g("involvedObject.name"))), g("message")).alias("message"),
        F.when(g("type") == "Warning", "warn").otherwise("info").alias("level"),
        at.alias("timestamp"),
    )


def workload_changes(docs: DataFrame, doc: str = "value") -> DataFrame:
    """(uid, name, generation, type, summary): changes between the generations of a workload; the first is where it starts from."""
    g = lambda path: F.get_json_object(doc, f"$.{path}")
    images = F.map_from_entries(F.from_json(g("spec.template.spec.containers"), "array<struct<name: string, image: string>>"))
    rows = docs.select(
        g("metadata.uid").alias("uid"), g("metadata.name").alias("name"), g("metadata.generation").cast("long").alias("generation"), images.alias("images"),
        g("spec.replicas").cast("long").alias("replicas"), F.get_json_object(doc, "$.spec.template.metadata.annotations['kubectl.kubernetes.io/restartedAt']").alias("restarted"),
    ).dropDuplicates(["uid", "generation"])
    w = Window.partitionBy("uid").orderBy("generation")
    was = lambda c: F.lag(c).over(w)
    rows = rows.select("*", was("generation").alias("g0"), was("images").alias("images0"), was("replicas").alias("replicas0"), was("restarted").alias("restarted0"))
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    new = F.map_filter("images", lambda k, v: ~v.eqNullSafe(F.element_at("images0", k)))
    kind = F.when(F.size(new) > 0, "deployment").when(differ("restarted", "restarted0"), "restart").when(differ("replicas", "replicas0"), "scale").otherwise("config")
    summary = F.when(F.size(new) > 0, F.array_join(F.array_sort(F.map_values(new)), ", ")).when(
        kind == "scale", F.concat_ws(" to ", F.col("replicas0").cast("string"), F.col("replicas").cast("string"))
    )
    return rows.filter("g0 is not null").select("uid", "name", "generation", kind.alias("type"), summary.alias("summary"))


def container_usage(stats: DataFrame) -> DataFrame:
    """``stats`` (container, ts, stats): CPU percent from each sample to the next, and memory without caches."""
    g = lambda path: F.get_json_object("stats", f"$.{path}").cast("double")
    w = Window.partitionBy("container").orderBy("ts")
    rows = stats.select(
        "container", "ts", g("cpu_stats.cpu_usage.total_usage").alias("used"), g("cpu_stats.system_cpu_usage").alias("system"), g("cpu_stats.online_cpus").alias("cpus"),
        (g("memory_stats.usage") - F.coalesce(g("memory_stats.stats.inactive_file"), g("memory_stats.stats.cache"), F.lit(0.0))).alias("memory"), g("memory_stats.limit").alias("limit"),
    )
    used, system = (F.col(c) - F.lag(c).over(w) for c in ("used", "system"))
    return rows.select(
        "container", "ts", F.when(system > 0, 100 * used / system * F.col("cpus")).alias("cpu_percent"), "memory", F.when(F.col("limit") > 0, 100 * F.col("memory") / F.col("limit")).alias("memory_percent")
    )


def container_service(labels: Column, label: str, name: Column) -> Column:
    """The label if there is one, else the name up to the first dot."""
    return F.coalesce(F.when(labels[label] != "", labels[label]), F.substring_index(F.ltrim(name, F.lit("/")), ".", 1))


def host_cpu(stat: DataFrame) -> DataFrame:
    """``stat`` (host, ts, line; the ``cpu`` line of kernel counters): share busy from each snapshot to the next."""
    n = F.transform(F.slice(F.split(F.trim("line"), r"\s+"), 2, 8), lambda x: x.cast("double"))
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    rows = stat.select("host", "ts", total.alias("total"), (n[3] + F.coalesce(F.get(n, F.lit(4)), F.lit(0.0))).alias("idle"))
    w = Window.partitionBy("host").orderBy("ts")
    d_total, d_idle = (F.col(c) - F.lag(c).over(w) for c in ("total", "idle"))
    return rows.select("host", "ts", F.when(d_total > 0, 100 * (d_total - d_idle) / d_total).alias("cpu_percent")).filter("cpu_percent is not null")


def host_memory(info: DataFrame) -> DataFrame:
    """``info`` (host, ts, text; the kernel's whole memory table): percent that isn't available; tables without a total go."""
    kb = lambda name: F.regexp_extract("text", rf"(?m)^{name}:\s+(\d+)", 1).try_cast("double")
    rows = info.select("host", "ts", kb("MemTotal").alias("total"), F.coalesce(kb("MemAvailable"), F.lit(0.0)).alias("free"))
    return rows.filter("total > 0").select("host", "ts", (100 * (1 - F.col("free") / F.col("total"))).alias("memory_percent"))


def host_load(averages: DataFrame) -> DataFrame:
    """``averages`` (host, ts, line; the kernel's load averages): the load of the last minute; lines without one go."""
    return averages.select("host", "ts", F.split(F.trim("line"), r"\s+")[0].try_cast("double").alias("load1")).filter("load1 is not null")


def host_disks(volumes: DataFrame) -> DataFrame:
    """``volumes`` (host, ts, path, blocks, available): percent of each that isn't available; those without blocks go."""
    used = 100 * (1 - F.col("available") / F.col("blocks"))
    return volumes.filter("blocks > 0").select("host", "ts", "path", used.alias("disk_percent"))


def host_samples(cpu: DataFrame, memory: DataFrame, load: DataFrame, disks: DataFrame) -> DataFrame:
    """(host, ts, name, value, labels) of what ``host_cpu``, ``host_memory``, ``host_load`` and ``host_disks`` give."""
    none = F.lit(None).cast("map<string, string>")
    # fixed values: the metrics' names
    named = lambda df, column, name, labels=none: df.select("host", "ts", F.lit(name).alias("name"), F.col(column).alias("value"), labels.alias("labels"))
    return (
        named(cpu, "cpu_percent", "system.cpu.percent")
        .union(named(memory, "memory_percent", "system.memory.used_percent"))
        .union(named(load, "load1", "system.load1"))
        .union(named(disks, "disk_percent", "system.disk.used_percent", F.create_map(F.lit("path"), F.col("path"))))
    )


def resource_metrics(samples: DataFrame) -> DataFrame:
    """``samples`` (ts, name, value, labels) of containers' instances: one sample a resource, region, time and metric.

    Instances come and go with the load, so a series by instance would never have a baseline.  Processor and memory are
    averages over instances (memory as a percentage of each one's limit), their number the largest, requests a sum.
    """
    label = lambda name: F.col("labels")[name]
    of = lambda name: F.when(F.col("name") == name, F.col("value"))
    each = samples.groupBy(label("resource_id").alias("resource_id"), label("region").alias("region"), "ts", label("resource_instance").alias("instance")).agg(
        *[F.avg(of(f"serverless_container_{n}")).alias(n) for n in ("cpu_usage_ratio", "memory_usage_bytes", "memory_limit_bytes", "instances_total", "requests_per_second")]
    )
    share = F.when(F.col("memory_limit_bytes") > 0, 100 * F.col("memory_usage_bytes") / F.col("memory_limit_bytes"))
    # fixed values: the metrics' names
    found = {
        "serverless.cpu.percent": F.avg("cpu_usage_ratio"), "serverless.memory.used_percent": F.avg(share),
        "serverless.instances": F.max("instances_total"), "serverless.requests_per_second": F.sum("requests_per_second"),
    }
    named = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in found.items()])
    wide = each.groupBy("resource_id", "region", "ts").agg(named.alias("all"))
    return wide.select("resource_id", "region", "ts", F.inline("all")).filter("value is not null")


def sample_service(labels: Column, label: str | None, query_service: str | None, default: str) -> Column:
    """Of a query's sample: the label that the query names, where it says something, else the query's service, else the default."""
    named = F.lit(query_service or default)
    return F.coalesce(F.when(labels[label] != "", labels[label]), named) if label else named


def by_time(entries: DataFrame) -> DataFrame:
    """Entries of ``log_responses`` in order of their nanoseconds; of equal ones by labels and line, so that reruns agree."""
    return entries.orderBy(F.col("ns").cast("bigint"), F.to_json("labels"), "line")


def log_responses(docs: DataFrame, doc: str = "value") -> DataFrame:
    """(labels, ns, line, message) of range responses; equal entries, as inclusive borders give again, once; blank ones go."""
    schema = "struct<data: struct<result: array<struct<stream: map<string, string>, values: array<array<string>>>>>>"
    r = docs.select(F.explode(F.from_json(doc, schema)["data"]["result"]).alias("r")).select("r.stream", F.explode("r.values").alias("v"))
    line = F.col("v")[1]
    inside = F.from_json(line, "resource_instance string, message string, stream string")
    message = F.when(line.startswith("{") & (inside["resource_instance"].isNotNull() | inside["stream"].isNotNull()), inside["message"]).otherwise(line)
    out = r.select(F.col("stream").alias("labels"), F.col("v")[0].alias("ns"), line.alias("line"), message.alias("message")).filter(F.trim(F.coalesce("message", F.lit(""))) != "")
    key = F.to_json("labels")
    return out.withColumn("_key", key).dropDuplicates(["_key", "ns", "line"]).drop("_key").withColumn("timestamp", F.timestamp_micros((F.col("ns").cast("bigint") / 1000).cast("bigint")))


def metric_responses(docs: DataFrame, doc: str = "value") -> DataFrame:
    """(labels, value, timestamp) of instant vector or scalar responses."""
    kind = F.get_json_object(doc, "$.data.resultType")
    vector = docs.filter(kind == "vector").select(
        F.explode(F.from_json(F.get_json_object(doc, "$.data.result"), "array<struct<metric: map<string, string>, value: array<string>>>")).alias("r")
    ).select(F.col("r.metric").alias("labels"), F.col("r.value").alias("v"))
    scalar = docs.filter(kind == "scalar").select(
        F.lit(None).cast("map<string, string>").alias("labels"), F.from_json(F.get_json_object(doc, "$.data.result"), "array<string>").alias("v")
    )
    number = F.regexp_replace(F.col("v")[1], "(?i)^([+-]?)inf$", "$1Infinity").try_cast("double")
    return vector.unionByName(scalar).select("labels", number.alias("value"), F.timestamp_micros((F.col("v")[0].cast("double") * 1_000_000).cast("bigint")).alias("timestamp"))


def routed(rows: DataFrame, routes: list[tuple[str, str]]) -> DataFrame:
    """``rows`` (message, service) with the service of the first pattern that the message fits, else their own."""
    service = F.col("service")
    for pattern, name in reversed(routes):
        service = F.when(F.col("message").rlike(pattern), name).otherwise(service)
    return rows.withColumn("service", service)


def excluded(rows: DataFrame, columns: list[str], patterns: list[str]) -> DataFrame:
    """``rows`` without those of which one of ``columns`` fits one of the shell globs."""
    test = F.lit(False)
    for c in columns:
        for p in patterns:
            test = test | F.coalesce(path_glob(F.col(c), p), F.lit(False))
    return rows.filter(~test)


def owner_service(labels: Column, names: list[str], owner_kind: Column, owner: Column, pod: Column) -> Column:
    """Of a pod: the first of its labels that is there, its owner (a replica set without its hash), its own name."""
    full = lambda c: F.when(c != "", c)
    return F.coalesce(*[full(labels[n]) for n in names], full(F.when(owner_kind == "ReplicaSet", F.regexp_replace(owner, "-[^-]*$", "")).otherwise(owner)), pod)


def running_counts(containers: DataFrame) -> DataFrame:
    """Running containers of each service, those that a deployment is about to switch to included."""
    return containers.groupBy("service").agg(F.count("*").alias("running"))


def measured(containers: DataFrame) -> DataFrame:
    """Containers whose usage counts: not those that a deployment is about to switch to."""
    return containers.filter(~F.col("name").rlike(r"\.upcoming-[0-9]+$"))
