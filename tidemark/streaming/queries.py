"""Streaming forms of the detectors, windows with watermarks, and the stream to the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.series import MIN_DELTAS
from tidemark.functions.templates import best_marking, informative, mask, tokens
from tidemark.operators import correlate, dampening, log_detector, metric_detector, mining
from tidemark.operators.folds import micros
from tidemark.shared import written
from tidemark.sources import event_log
from tidemark.streaming.folds import stream_fold


def metric_judgements(
    samples: DataFrame,
    config: metric_detector.MetricConfig = metric_detector.MetricConfig(),
    rules: dict[str, tuple[float | None, float | None]] | None = None,
    ignored: list[str] | None = None,
    deltas: dict[str, float] = MIN_DELTAS,
    ttl_s: float | None = None,
) -> DataFrame:
    """``samples`` (series, metric, event_id, ts, value) as ``metric_detector.judge`` has them; series idle for ``ttl_s`` leave the state."""
    rows = metric_detector.prepared(samples, rules, ignored, deltas)
    return stream_fold(rows, ["series"], ["ts", "event_id"], metric_detector.STEP, lambda: metric_detector.Series(config), metric_detector.SAMPLE, ttl_s)


def mined(lines: DataFrame, config: mining.MinerConfig = mining.MinerConfig()) -> DataFrame:
    """``lines`` (source, seq, ts, message): their templates; seq is a long."""
    rows = lines.select("source", "seq", micros("ts"), tokens(mask(F.col("message"))).alias("words"))
    found = stream_fold(
        rows, ["source"], ["ts", "seq"], ["seq", "words"], lambda: mining._Mining(config), f"seq long, words array<string>, {mining.MATCHED}"
    )
    return found.select(
        "source", "seq", F.col("cluster_id").cast("string").alias("template_id"), F.array_join("template", " ").alias("template"), "change_type", F.col("size").alias("cluster_size")
    )


def log_signals(rows: DataFrame, config: log_detector.LogConfig = log_detector.LogConfig(), markings: dict[str, str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """``rows`` (source, seq, ts, template_id, template, change_type): signals."""
    own = rows.select(
        "source", "seq", micros("ts"), "template_id", "template", "change_type",
        best_marking(F.col("template"), markings or {}, patterns or {}).alias("marking"), informative(F.col("template")).alias("says"),
    )
    columns = ["seq", "ts", "template_id", "template", "change_type", "marking", "says"]
    return stream_fold(own, ["source"], ["ts", "seq"], columns, lambda: log_detector.Source(config), log_detector.SIGNALS)


def dampened(signals: DataFrame, config: dampening.DampenConfig = dampening.DampenConfig(), ttl_s: float | None = None) -> DataFrame:
    """As ``dampening.dampen``; ``ttl_s``, more than the longest silence, is when a pattern that doesn't come again is evicted."""
    rows = signals.select("kind", "source", "pattern", "seq", micros("ts"), "score")
    return stream_fold(rows, ["kind", "source", "pattern"], ["ts", "seq"], ["seq", "ts", "score"], lambda: dampening.Pattern(config), dampening.REPORTED, ttl_s)


def bucket_counts(rows: DataFrame, width: str = "1 minute", late: str = "0 seconds") -> DataFrame:
    """``rows`` (source, template_id, ts): counts of tumbling buckets, once the watermark has passed them."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("source", "template_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(
        "source", "template_id", F.col("w.start").alias("bucket"), "n"
    )


def append_once(events: DataFrame, path: str) -> None:
    """Events that the log doesn't have yet, to the folder of their day if they have a ``timestamp``, else of today."""
    dated = "timestamp" in events.columns
    day = F.to_date("timestamp") if dated else F.current_date()
    days = [str(r[0]) for r in events.select(day).distinct().collect()] if dated else None
    stored = event_log.stored_ids(events.sparkSession, path, days)
    event_log.append(written(event_log.append_new(events, stored)), path, day)  # read before the log is written to


def to_event_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to the event log, each id once: a batch that runs again after a failure adds what is missing.

    Events with a ``timestamp`` go to the folder of its day, so that ids are looked for in the batch's days only.
    """
    write = lambda batch, _: append_once(batch, path)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(signals: DataFrame, width_s: float = correlate.WINDOW_S) -> DataFrame:
    """``signals`` (source, seq, ts): (source, seq, window_us), the window of 30 seconds that each falls in."""
    width = int(width_s * 1_000_000)
    return stream_fold(signals.select("source", "seq", micros("ts")), ["source"], ["ts", "seq"], ["seq", "ts"], lambda: correlate._Anchored(width), "seq long, window_us long")
