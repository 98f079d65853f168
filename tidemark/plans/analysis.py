"""The whole chain in batch: from observations to anomaly events and incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.series import series_key
from tidemark.functions.templates import MASKS
from tidemark.functions.text import normalize
from tidemark.operators import correlate, dampening, incidents, log_detector, metric_detector, mining, state
from tidemark.operators.folds import Resume
from tidemark.shared import written

SECOND = 1_000_000


@dataclass(frozen=True)
class Analysis:
    """What the steps gave: signals and events are computed and kept, the rest is computed when asked for."""

    observations: DataFrame
    mined: DataFrame
    signals: DataFrame
    events: DataFrame


def miner_config(config: Config) -> mining.MinerConfig:
    d = config.logs.drain
    return mining.MinerConfig(d.depth, d.similarity_threshold, d.max_children, d.max_clusters, d.parametrize_numeric_tokens)


def log_config(config: Config) -> log_detector.LogConfig:
    d = config.logs.detection
    return log_detector.LogConfig(
        learning_us=int(d.learning_period * SECOND), rare_count=d.rare_threshold, rare_total=d.rare_min_observations, rare_interval_s=float(d.rare_max_interval),
        bucket_us=int(d.spike_bucket * SECOND), spike_factor=d.spike_factor, spike_count=d.spike_min_count, missing_factor=d.disappearance_factor,
        missing_count=d.disappearance_min_count, scan_us=int(d.disappearance_scan_interval * SECOND), silence_s=float(d.disappearance_min_silence),
        all_templates=d.disappearance_scope == "all", max_cv=d.disappearance_max_cv, hourly=d.seasonality == "hourly", hourly_seen=d.seasonal_min_observations, max_templates=d.max_templates,
    )


def metric_config(config: Config) -> metric_detector.MetricConfig:
    d = config.metrics.detection
    return metric_detector.MetricConfig(
        warmup=d.warmup_samples, alpha=d.alpha, z_threshold=d.z_threshold, fast=d.trend_fast_alpha, slow=d.trend_slow_alpha, trend=d.trend_threshold,
        daily=d.seasonality == "daily", tolerance_us=int(d.seasonal_tolerance * SECOND), days=d.seasonal_days, ttl_us=int(d.series_ttl * SECOND), max_series=d.max_series,
    )


def _part(resume: Resume | None, name: str) -> Resume | None:
    return resume and Resume(f"{resume.after}/{name}", resume.before and f"{resume.before}/{name}")


def _log_signals(logs: DataFrame, config: Config, resume: Resume | None) -> tuple[DataFrame, DataFrame]:
    d = config.logs
    set_ = state.part(logs.sparkSession, resume.before, "markings").collect() if resume and resume.before else []  # as many as people have set
    own = lambda kind: {r["name"]: r["marking"] for r in set_ if r["kind"] == kind}
    masks = [(m.mask_with, m.pattern) for m in d.drain.masking] or MASKS
    message = F.coalesce(F.when(F.col("log.message") != "", F.col("log.message")), F.col("log.raw"))
    rows = logs.select("source", F.col("id").alias("seq"), F.col("timestamp").cast("timestamp_ntz").alias("ts"), message.alias("message"))
    mined = mining.mine(rows, ["ts", "seq"], "seq", miner_config(config), masks, carry=("ts",), resume=_part(resume, "miner"))
    found = log_detector.detect(mined, log_config(config), {**d.detection.markings, **own("template")}, {**d.detection.patterns, **own("pattern")}, d.detection.min_template_literals, d.detection.max_placeholder_ratio, _part(resume, "logs"))
    what = F.regexp_replace(F.split_part("kind", F.lit("."), F.lit(2)), "_", " ")
    return mined, found.select(
        "source", "seq", F.timestamp_micros("ts_us").alias("ts"), "kind", F.lit("log").alias("modality"), "score", F.concat(what, F.lit(": "), "template").alias("summary"),
        F.concat_ws("/", "kind", "template_id").alias("merge_key"), F.col("template").alias("pattern"), "marking",
    )


def _metric_signals(metrics: DataFrame, config: Config, resume: Resume | None) -> DataFrame:
    d = config.metrics.detection
    set_ = state.part(metrics.sparkSession, resume.before, "ignored").collect() if resume and resume.before else []
    rows = metrics.select(
        "source", series_key(F.col("source"), F.col("metric.name"), F.col("metric.labels")).alias("series"), F.col("metric.name").alias("metric"), F.col("id").alias("event_id"),
        F.col("timestamp").alias("ts"), F.col("metric.value").alias("value"),
    )
    judged = metric_detector.judge(rows, metric_config(config), {t.metric: (t.max, t.min) for t in d.thresholds}, [*d.ignored, *(r["glob"] for r in set_)], d.min_deltas, ("source", "metric", "series"), _part(resume, "metrics"))
    named = metric_detector.signals(judged)
    summary = F.concat(F.col("metric"), F.lit(" = "), F.round("value", 4).cast("string"), F.lit(": "), F.regexp_replace(F.split_part("kind", F.lit("."), F.lit(2)), "_", " "))
    return named.select(
        "source", F.col("event_id").alias("seq"), F.timestamp_micros("ts_us").alias("ts"), "kind", F.lit("metric").alias("modality"), "score", summary.alias("summary"),
        F.concat_ws("/", "kind", "metric").alias("merge_key"), F.col("series").alias("pattern"), F.lit(None).cast("string").alias("marking"),
    )


def analyze(observations: DataFrame, config: Config = Config(), resume: Resume | None = None) -> Analysis:
    """``observations`` as of ``schema.OBSERVATION``; rejected ones are left out.

    ``resume``: folders of what templates, logs and metrics have learned, before and after this run; the run goes by the markings and
    ignored globs that were set there (``operators.state``).  Cooldowns, windows and incidents don't reach over runs.
    """
    own = normalize(observations).filter("rejected is null")
    mined, from_logs = _log_signals(own.filter("modality = 'log'"), config, resume)
    parts = [from_logs] if config.logs.detection.enabled else []
    if config.metrics.detection.enabled:
        parts.append(_metric_signals(own.filter("modality = 'metric'"), config, resume))
    signals = parts[0] if parts else from_logs.limit(0)
    for more in parts[1:]:
        signals = signals.unionByName(more)
    signals = written(signals)  # few beside the observations, and read more than once
    d = config.dampening
    limits = dampening.DampenConfig(int(d.cooldown * SECOND), int(d.max_cooldown * SECOND), d.escalation, d.max_tracked)
    # a signal belongs to the service and environment of its observation
    signals = signals.join(own.select(F.col("id").alias("seq"), "service", "environment"), "seq", "left")
    told = dampening.dampen(signals, limits).filter("reported").select("kind", "source", "pattern", "seq", "suppressed", "repeats", "escalated_from")
    signals = written(signals.join(told, ["kind", "source", "pattern", "seq"]))
    change = F.col("change")
    changes = written(
        own.filter("modality = 'change'").select(
            "source", F.col("id").alias("change_id"), F.col("timestamp").alias("ts"), change["type"].alias("type"), change["version"].alias("version"), change["summary"].alias("summary")
        )
    )
    c = config.correlation
    # signals that another source's change explains are told as its echo, not as events of their own
    echoed = correlate.echoes(signals, changes, int(c.change_horizon), int(c.echo_window)).select("seq")
    kept = written(signals.join(echoed, "seq", "left_anti"))
    seen = own.select("source", F.col("timestamp").alias("ts"), F.col("id").alias("seq"))
    events = correlate.build_events(kept, changes, c.window, int(c.change_horizon), seen)
    wakes = correlate.echo_events(signals, changes, int(c.change_horizon), int(c.echo_window))
    if resume and resume.before:
        state.keep_settings(own.sparkSession, resume.before, resume.after)
    return Analysis(own, mined, signals, written(events.unionByName(wakes, allowMissingColumns=True)))


def anomalies(events: DataFrame) -> DataFrame:
    """Of an event log's rows, those that incidents are made of: debug events and the like aren't."""
    return events.filter(F.col("kind").startswith("anomaly."))


def incidents_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, incidents) of the events of ``analyze``."""
    rows = anomalies(events).select(
        "event_id", "ts", F.col("source").alias("service"), F.coalesce(F.transform("related_changes", lambda c: c["change_id"]), F.array().cast("array<string>")).alias("change_keys"),
        "severity", "confidence", F.coalesce("summary", F.col("signals")[0]["kind"]).alias("summary"),
    )
    members = incidents.group_events(rows)
    return members, incidents.incident_table(rows, members)
