"""Column functions that read log lines: prefixes, JSON envelopes, levels, times and normalization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
#: What counts as a terminal's escape sequence and as a process before a message, keys that JSON envelopes may have, in
#: order, and words for levels.
ANSI = r"\x1b\[[0-9;?]*[@-~]"
PROCESS_PREFIX = r"^([A-Za-z0-9_.-]+)\[([^\]\s]+)\]:\s+"
MESSAGE_KEYS = ("message", "msg", "log")
LEVEL_KEYS = ("level", "severity", "lvl", "loglevel")
TIME_KEYS = ("time", "ts", "timestamp", "@timestamp")
LEVELS = {
    "debug": ("trace", "debug"),
    "info": ("info", "informational", "notice"),
    "warn": ("warn", "warning"),
    "error": ("error", "err"),
    "fatal": ("fatal", "critical", "crit", "panic", "emerg", "alert"),
}
DEFAULT_ENVIRONMENT = "default"
MAX_LOG_BYTES = 8192


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def level_of(value: Column) -> Column:
    """The level that a word or a syslog priority names, or null."""
    v = value.cast("string")
    priority = v.try_cast("bigint")
    by_number = (
        F.when(priority <= 2, "fatal").when(priority == 3, "error").when(priority == 4, "warn").when(priority <= 6, "info").when(priority == 7, "debug")
    )
    by_word = F.lit(None).cast("string")
    for level, words in LEVELS.items():
        by_word = F.when(F.lower(v).isin(*words), level).otherwise(by_word)
    return F.when(priority.isNotNull(), by_number).otherwise(by_word)


def epoch_time(value: Column) -> Column:
    """Seconds, milliseconds or microseconds since 1970 by magnitude; null for smaller numbers."""
    v = value.cast("double")
    return (
        F.when(v > 1e14, F.timestamp_micros(v.cast("bigint")))
        .when(v > 1e11, F.timestamp_millis(v.cast("bigint")))
        .when(v > 1e8, F.timestamp_micros((v * 1_000_000).cast("bigint")))
    )


def rfc3339(value: Column) -> Column:
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(value))


def time_of(value: Column) -> Column:
    """A time from RFC 3339, ``yyyy-MM-dd HH:mm:ss``, an offset without a colon, or an epoch number."""
    v = value.cast("string")
    spaced = F.when(v.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(v))
    close = F.regexp_replace(v, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.coalesce(rfc3339(v), spaced, rfc3339(close), epoch_time(v.try_cast("double")))


def parse_lines(
    lines: DataFrame,
    message_keys: Sequence[str] = MESSAGE_KEYS,
    level_keys: Sequence[str] = LEVEL_KEYS,
    time_keys: Sequence[str] = TIME_KEYS,
) -> DataFrame:
    """``lines`` (raw, message, level, timestamp, ...) with message, level, timestamp and log_process from raw.

    Rows that already have a message keep it, and only their level is normalized, where it is known.  Otherwise escape sequences,
    a leading time and a bracketed process go from the line, and a JSON object gives up its text, level and time.
    """
    given = blank_to_null(F.col("message"))
    clean = F.trim(F.col("raw"))
    clean = F.when(F.contains(clean, F.lit("\x1b")), F.regexp_replace(clean, ANSI, "")).otherwise(clean)
    out = lines.withColumn("_given", given.isNotNull()).withColumn("_text", clean)
    word = F.split_part("_text", F.lit(" "), F.lit(1))
    out = out.withColumn("_time", rfc3339(word)).withColumn(
        "_text", F.when(F.col("_time").isNotNull(), F.ltrim(F.substring("_text", F.length(word) + 1, F.length("_text")))).otherwise(F.col("_text"))
    )
    out = out.withColumn("_process", blank_to_null(F.regexp_extract("_text", r"^([A-Za-z0-9_.-]+\[[^\]\s]+\]):\s+", 1))).withColumn(
        "_text", F.regexp_replace("_text", PROCESS_PREFIX, "")
    )
    out = out.withColumn("_json", F.when(F.col("_text").startswith("{"), F.try_parse_json("_text")))

    def entry(key: str) -> tuple[Column, Column]:
        path = f'$["{key}"]'
        return F.try_variant_get("_json", path, "string"), F.schema_of_variant(F.try_variant_get("_json", path, "variant"))

    def text(key: str) -> Column:
        value, kind = entry(key)
        return F.when(kind == "STRING", blank_to_null(F.trim(value)))

    def scalar(key: str) -> Column:
        value, kind = entry(key)
        return F.when(kind.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL)"), value)

    message = F.coalesce(*[text(k) for k in message_keys], F.when(F.col("_text") != F.trim("raw"), F.col("_text")))
    level = F.coalesce(*[level_of(scalar(k)) for k in level_keys])
    time = F.coalesce(*[time_of(scalar(k)) for k in time_keys])
    own = F.col("_given")
    return out.withColumns(
        {
            "message": F.when(own, F.col("message")).otherwise(message),
            "level": F.when(own, F.coalesce(level_of(F.col("level")), blank_to_null(F.col("level")))).otherwise(level),
            "timestamp": F.when(own, F.col("timestamp")).otherwise(F.coalesce("timestamp", "_time", time)),
            "log_process": F.when(~own, F.col("_process")),
        }
    ).drop("_given", "_text", "_time", "_process", "_json")


def source_of(environment: Column, service: Column) -> Column:
    """``environment/service``; null without a service."""
    return F.concat_ws("/", F.coalesce(blank_to_null(environment), F.lit(DEFAULT_ENVIRONMENT)), blank_to_null(service))


def cut_bytes(text: Column, most: int = MAX_LOG_BYTES) -> Column:
    """The longest start of ``text`` of whole characters in ``most`` bytes of UTF-8."""
    cut = F.substring(F.encode(text, "utf-8"), 1, most)
    whole = F.regexp_replace(F.hex(cut), "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(whole), "utf-8"))


def normalize(observations: DataFrame) -> DataFrame:
    """Source, environment, time and id of observations, and why a row is rejected (null: accepted).

    Takes the columns of ``schema.OBSERVATION``; ids are digests, so that reruns agree.
    """
    service, source = blank_to_null(F.col("service")), blank_to_null(F.col("source"))
    out = observations.withColumns(
        {
            "environment": F.coalesce(blank_to_null(F.col("environment")), F.lit(DEFAULT_ENVIRONMENT)),
            "source": F.when(service.isNotNull(), source_of(F.col("environment"), service)).otherwise(source),
            "timestamp": F.coalesce("timestamp", "ingested_at"),
            "log": F.when(F.col("log").isNotNull(), F.col("log").withField("raw", cut_bytes(F.col("log.raw"))).withField("message", cut_bytes(F.col("log.message")))),
        }
    )
    payload = F.when(F.col("modality") == "log", F.col("log").isNotNull()).when(F.col("modality") == "metric", F.col("metric").isNotNull()).when(
        F.col("modality") == "change", F.col("change").isNotNull()
    )
    reason = (
        F.when(F.col("source").isNull(), "no service or source").when(payload.isNull(), "unknown modality").when(~payload, "no payload")
    )
    digest = F.sha2(F.concat_ws("\x1f", "source", "modality", F.col("timestamp").cast("string"), F.to_json(F.struct("log", "metric", "change"))), 256)
    return out.withColumn("id", F.coalesce(blank_to_null(F.col("id")), F.substring(digest, 1, 32))).withColumn("rejected", reason)
