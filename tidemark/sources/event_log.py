"""Sinks of events, and the event log: JSON lines in a folder for each day of writing."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days by which an event's own day may lie before or after the day it was written.
SLACK_BEFORE, SLACK_AFTER = 2, 1
#: The longest pause between attempts of a sink.
MAX_PAUSE_S = 30.0


def append(events: DataFrame, path: str, day: Column | None = None) -> None:
    day = F.current_date() if day is None else day
    # microseconds, which Spark's own format cuts off
    log = events.withColumn("day", day.cast("string")).write.mode("append").partitionBy("day")
    log.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def query(spark: SparkSession, path: str, schema: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events of [since, until] (timestamps as text); only folders of days that can hold them are read; torn lines go."""
    log = spark.read.schema(f"{schema}, day string").option("mode", "DROPMALFORMED").json(path)
    if since:
        log = log.filter((F.col("day") >= F.date_sub(F.lit(since).cast("date"), SLACK_BEFORE).cast("string")) & (F.col("timestamp") >= F.lit(since).cast("timestamp")))
    if until:
        log = log.filter((F.col("day") <= F.date_add(F.lit(until).cast("date"), SLACK_AFTER).cast("string")) & (F.col("timestamp") <= F.lit(until).cast("timestamp")))
    return log.drop("day")


def stored_ids(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """The ids in the log, in the folders of ``days`` if given; none before the log's first event."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], "id string")
    log = spark.read.schema("id string, day string").option("mode", "DROPMALFORMED").json(path)
    return (log if days is None else log.filter(F.col("day").isin(days))).select("id")


def prune(spark: SparkSession, path: str, before_day: str) -> list[str]:
    """Deletes the folders of days before ``before_day``; gives their days."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < before_day:
            fs.delete(status.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def json_lines(events: DataFrame) -> DataFrame:
    """One document a row, without null fields."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def append_new(events: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Events whose id isn't stored yet, each once: appending these again changes nothing."""
    return events.dropDuplicates(["id"]).join(stored_ids.select("id"), "id", "left_anti")


def write_jdbc(events: DataFrame, url: str, table: str, **properties: str) -> None:
    """Appends events that the table doesn't have as (id, source, timestamp, payload)."""
    reader = events.sparkSession.read.jdbc(url, table, properties=properties)
    rows = append_new(events, reader)
    rows.select("id", "source", "timestamp", F.to_json(F.struct(*events.columns)).alias("payload")).write.jdbc(url, table, "append", properties)


def post(events: DataFrame, url: str, timeout_s: float = 10.0, attempts: int = 5, pause_s: float = 1.0, drop: bool = False) -> int:
    """Posts each event; an answer of 300 or more, or none, is tried again after pauses that double up to MAX_PAUSE_S.

    After the last attempt the task fails, and Spark retries it (events before that one are posted again); with ``drop`` the event
    is left out instead.  Gives the number of events left out; those of tasks that ran twice count twice.
    """
    dropped = events.sparkSession.sparkContext.accumulator(0)

    def sent(body: bytes) -> bool:
        pause = pause_s
        for left in range(attempts - 1, -1, -1):
            try:
                request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                    if answer.status < 300:
                        return True
                    raise OSError(f"status {answer.status}")
            except OSError:
                if not left and not drop:
                    raise
            if left:
                time.sleep(pause)
                pause = min(2 * pause, MAX_PAUSE_S)
        return False

    def send(rows: Iterator) -> None:
        for row in rows:
            if not sent(row["value"].encode()):
                dropped.add(1)

    json_lines(events).foreachPartition(send)
    return dropped.value


def document(line: str) -> dict:
    return json.loads(line)
