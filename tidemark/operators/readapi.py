"""Reads of events, templates and series: filters, orders, pages, dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import sigma
from tidemark.functions.templates import path_glob

NEWEST = 500


def newest(events: DataFrame, since: Column | None = None, until: Column | None = None, limit: int = NEWEST) -> DataFrame:
    """The newest ``limit`` events of [since, until], oldest first."""
    for bound, keep in ((since, lambda b: F.col("ts") >= b), (until, lambda b: F.col("ts") <= b)):
        events = events.filter(keep(bound)) if bound is not None else events
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit).orderBy("ts", "event_id")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def containing(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows in which one of ``columns`` contains ``text`` in any case."""
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return rows.filter(F.coalesce(test, F.lit(False)))


def series_by_sigma(series: DataFrame) -> DataFrame:
    """``series`` (series, mean, std_dev, recent) with sigma and band, the furthest off first."""
    out = series.withColumn("sigma", sigma(F.col("recent"), F.col("mean"), F.col("std_dev")))
    band = F.when(F.abs("sigma") >= 3, "hot").when(F.abs("sigma") >= 1, "warm").otherwise("calm")
    return out.withColumns({"band": band, "bar": F.least(F.lit(1.0), F.abs("sigma") / 12)}).orderBy(F.abs("sigma").desc(), "series")


def forget(state: DataFrame, column: str, pattern: str) -> DataFrame:
    """``state`` without the rows that the glob fits."""
    return state.filter(~path_glob(F.col(column), pattern))


def forget_counts(state: DataFrame, column: str, pattern: str) -> DataFrame:
    return state.filter(path_glob(F.col(column), pattern)).groupBy(column).agg(F.count("*").alias("n"))


def mark(markings: DataFrame, kind: str, name: str, marking: str | None) -> DataFrame:
    """``markings`` (kind, name, marking) with one of them set, or taken away with None."""
    kept = markings.filter(~((F.col("kind") == kind) & (F.col("name") == name)))
    if marking is None:
        return kept
    return kept.unionByName(markings.sparkSession.createDataFrame([(kind, name, marking)], "kind string, name string, marking string"))


def resolve_units(rows: DataFrame, identifier: str, unit: str) -> DataFrame:
    """``rows`` with resolved: their unit, else the only unit that others with the same identifier have."""
    known = (
        rows.filter(F.col(unit).isNotNull())
        .groupBy(F.lower(identifier).alias("_id"))
        .agg(F.min(unit).alias("_low"), F.max(unit).alias("_high"))
        .filter("_low = _high")
        .select("_id", F.col("_low").alias("_unit"))
    )
    return rows.join(known, F.lower(F.col(identifier)) == F.col("_id"), "left").withColumn("resolved", F.coalesce(unit, "_unit")).drop("_id", "_unit")


def lookup(rows: DataFrame, directory: DataFrame, key: str, name: str, fallback: Column) -> DataFrame:
    """``rows`` with name from ``directory`` (key, name), else the fallback."""
    known = directory.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    return rows.join(known, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_name", fallback)).drop("_key", "_name")


def template_rows(templates: DataFrame, markings: DataFrame, text: str = "", marking: str | None = None) -> DataFrame:
    """``templates`` (source, template_id, template, size) with their marking, the largest first.

    ``markings`` (kind, name, marking).  ``text`` must be in template or source; ``marking``: one of them, ``none`` or ``any``.
    """
    own = markings.filter("kind = 'template'").select(F.col("name").alias("_name"), "marking")
    out = containing(templates, ["template", "source"], text).join(own, F.col("template") == F.col("_name"), "left").drop("_name")
    if marking == "none":
        out = out.filter("marking is null")
    elif marking == "any":
        out = out.filter("marking is not null")
    elif marking:
        out = out.filter(F.col("marking") == marking)
    return out.orderBy(F.col("size").desc(), "template")


def series_rows(series: DataFrame) -> DataFrame:
    """``series`` (series, samples, mean, std_dev, recent, warmup): by deviation, the ones that moved off a flat line first, those in warm-up last."""
    off = F.abs(F.col("recent") - F.col("mean"))
    deviation = F.when(F.col("warmup"), None).when(F.col("std_dev") > 0, off / F.col("std_dev")).when(off > 0, F.lit(float("inf"))).otherwise(0.0)
    return series.withColumn("deviation", deviation).orderBy(F.col("deviation").desc_nulls_last(), "series")


def empty_state(events: DataFrame, templates: DataFrame, series: DataFrame) -> DataFrame:
    """One row: how many events, templates and series in warm-up there are."""
    counts = (events.agg(F.count("*").alias("events")), templates.agg(F.count("*").alias("templates")), series.agg(F.count_if("warmup").alias("warming")))
    return counts[0].join(counts[1]).join(counts[2])
