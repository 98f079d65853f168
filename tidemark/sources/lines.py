"""Readers of line sources, batch or streaming, as observations of one service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.series import prometheus_sample
from tidemark.functions.text import parse_lines, rfc3339
from tidemark.schema import CHANGE, LOG, METRIC


def _text(spark: SparkSession, path: str, stream: bool, max_files: int | None = None) -> DataFrame:
    """``max_files``: files that a stream takes in one micro-batch, all that are there if not given."""
    reader = spark.readStream if stream else spark.read
    return (reader.option("maxFilesPerTrigger", max_files) if stream and max_files else reader).text(path)


def _observation(rows: DataFrame, modality: str, service: Column, environment: Column, **payload: Column) -> DataFrame:
    """The columns of an observation; what isn't given is null."""
    kinds = {"log": LOG, "metric": METRIC, "change": CHANGE}
    have = lambda name, kind: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    return rows.select(
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("source"),
        service.alias("service"),
        environment.alias("environment"),
        F.lit(modality).alias("modality"),
        have("timestamp", "timestamp").alias("timestamp"),
        F.current_timestamp().alias("ingested_at"),
        have("attributes", "map<string, string>").alias("attributes"),
        *[payload.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()],
    )


def log_struct(raw: Column, message: Column, level: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        raw.alias("raw"), message.alias("message"), level.alias("level"), none.cast("string").alias("template_id"), none.cast("string").alias("template"), none.cast("array<string>").alias("parameters")
    )


def log_lines(spark: SparkSession, path: str, service: str, environment: str = "default", stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Text lines that aren't blank, parsed."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = _text(spark, path, stream, max_files).filter(F.trim("value") != "").select(
        F.col("value").alias("raw"), none("string").alias("message"), none("string").alias("level"), none("timestamp").alias("timestamp")
    )
    rows = parse_lines(rows).withColumn("attributes", F.when(F.col("log_process").isNotNull(), F.create_map(F.lit("log.process"), "log_process")))
    return _observation(rows, "log", F.lit(service), F.lit(environment), log=log_struct(F.col("raw"), F.col("message"), F.col("level")))


def metric_lines(spark: SparkSession, path: str, service: str, environment: str = "default", stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Lines of text exposition; malformed ones, comments and blanks are left out."""
    rows = _text(spark, path, stream, max_files).select(prometheus_sample(F.col("value")).alias("s")).filter("s is not null")
    rows = rows.withColumn("timestamp", F.col("s.timestamp"))
    return _observation(rows, "metric", F.lit(service), F.lit(environment), metric=F.struct("s.name", "s.value", "s.labels"))


def change_lines(spark: SparkSession, path: str, service: str, environment: str = "default", stream: bool = False, max_files: int | None = None) -> DataFrame:
    """JSON lines of time, type, version and summary; malformed ones are left out."""
    rows = _text(spark, path, stream, max_files).select(F.from_json("value", "time string, type string, version string, summary string").alias("c"))
    rows = rows.filter("c is not null and (c.time is not null or c.type is not null or c.version is not null or c.summary is not null)")
    rows = rows.withColumn("timestamp", rfc3339(F.col("c.time")))
    return _observation(rows, "change", F.lit(service), F.lit(environment), change=F.struct("c.type", "c.version", "c.summary"))


def union(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; missing columns are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
