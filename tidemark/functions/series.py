"""Column functions around metric series, durations and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.templates import path_glob

#: The least deviation that counts, by metric.
MIN_DELTAS = {"*percent": 10.0}
SEVERITIES = ("info", "warning", "critical")


def series_key(source: Column, name: Column, labels: Column) -> Column:
    """``source/name`` and each label in braces, by label name."""
    braces = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(F.lit("{"), e["key"], F.lit("="), e["value"], F.lit("}")))
    return F.concat(source, F.lit("/"), name, F.coalesce(F.array_join(braces, ""), F.lit("")))


def metric_name(key: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(key, r"(?s)\{.*$", ""), "([^/]*)$", 1)


def min_delta(name: Column, deltas: dict[str, float] = MIN_DELTAS) -> Column:
    """The metric's own value, else the largest of the globs that fit, else 0."""
    globs = [F.when(path_glob(name, p), F.lit(float(d))).otherwise(F.lit(0.0)) for p, d in deltas.items()]
    out = F.greatest(*globs, F.lit(0.0)) if len(globs) > 0 else F.lit(0.0)
    for exact, d in deltas.items():
        out = F.when(name == exact, F.lit(float(d))).otherwise(out)
    return out


def prometheus_sample(line: Column) -> Column:
    """struct<name, labels, value, timestamp> of a line of text exposition; null if blank, a comment or malformed."""
    text = F.trim(line)
    name = F.regexp_extract(text, r"^([A-Za-z0-9_:]+)", 1)
    label = r'[ \t]*[A-Za-z0-9_:]+="(?:[^"\\]|\\.)*",?'
    whole = rf'(?s)^[A-Za-z0-9_:]+(\{{(?:{label})*[ \t]*\}})?\s*(\S+)(?:\s+(-?\d+))?$'
    block = F.regexp_extract(text, whole, 1)
    value = F.regexp_extract(text, whole, 2)
    number = F.regexp_replace(value, "(?i)^([+-]?)inf$", "$1Infinity").try_cast("double")
    pairs = F.regexp_extract_all(block, F.lit(r'(?s)([A-Za-z0-9_:]+="(?:[^"\\]|\\.)*")'), F.lit(1))
    key = lambda p: F.substring_index(p, "=", 1)
    quoted = lambda p: F.regexp_extract(p, r'(?s)^[^=]*="(.*)"$', 1)
    plain = lambda v: F.regexp_replace(F.replace(v, F.lit("\\n"), F.lit("\n")), r"(?s)\\(.)", "$1")
    # a backslash before a backslash must not meet the n behind it
    safe = lambda v: F.replace(plain(F.replace(v, F.lit("\\\\"), F.lit("\x00"))), F.lit("\x00"), F.lit("\\"))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(key(p), safe(quoted(p)))))
    millis = F.regexp_extract(text, whole, 3)
    good = text.rlike(whole) & ~text.startswith("#") & number.isNotNull()
    return F.when(
        good,
        F.struct(name.alias("name"), labels.alias("labels"), number.alias("value"), F.timestamp_millis(millis.try_cast("bigint")).alias("timestamp")),
    )


def _two_units(major: Column, a: str, minor: Column, b: str) -> Column:
    return F.concat(major.cast("string"), F.lit(a), F.when(minor > 0, F.concat(F.lit(" "), minor.cast("string"), F.lit(b))).otherwise(""))


def humanized(seconds: Column) -> Column:
    """A duration in at most two units, rounded to what is shown."""
    s = F.abs(seconds)
    tenths, whole = F.round(s * 10).cast("bigint"), F.round(s).cast("bigint")
    minutes, hours = F.round(s / 60).cast("bigint"), F.round(s / 3600).cast("bigint")
    short = F.concat(F.regexp_replace(F.format_string("%.1f", tenths / 10), r"\.0$", ""), F.lit("s"))
    text = (
        F.when(tenths == 0, F.lit("<0.1s"))
        .when((s < 10) & (tenths < 100), short)
        .when((s < 3600) & (whole < 60), F.concat(whole.cast("string"), F.lit("s")))
        .when((s < 3600) & (whole < 3600), _two_units(F.floor(whole / 60), "m", whole % 60, "s"))
        .when((s < 86400) & (minutes < 1440), _two_units(F.floor(minutes / 60), "h", minutes % 60, "m"))
        .otherwise(_two_units(F.floor(hours / 24), "d", hours % 24, "h"))
    )
    return F.when(seconds == 0, "0s").otherwise(F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def signed(seconds: Column) -> Column:
    return F.concat(F.when(seconds >= 0, "+").otherwise(""), humanized(seconds))


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(SEVERITIES, 1):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("", *SEVERITIES)]), (rank + 1).cast("int"))


def sigma(recent: Column, mean: Column, std_dev: Column) -> Column:
    return F.when(std_dev > 0, (recent - mean) / std_dev).otherwise(F.lit(0.0))
