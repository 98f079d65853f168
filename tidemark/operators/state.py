"""What runs have learned, as tables: lists of it, and edits that the next run goes by.

A state is a folder as ``analysis.analyze`` writes it: tables ``miner``, ``logs`` and ``metrics``, and, once something was set, ``markings`` (kind, name,
marking) and ``ignored`` (glob).  States aren't changed; an edit writes another folder, from which a run may go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.templates import path_glob, text_glob
from tidemark.operators import readapi

PARTS = ("miner", "logs", "metrics")
MARKINGS, IGNORED = "kind string, name string, marking string", "glob string"
SETTINGS = {"markings": MARKINGS, "ignored": IGNORED}


def _there(spark: SparkSession, folder: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def part(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a state; settings that were never made are empty."""
    if name in SETTINGS and not _there(spark, folder, name):
        return spark.createDataFrame([], SETTINGS[name])
    return spark.read.parquet(f"{folder}/{name}")


def _written(spark: SparkSession, before: str, after: str, changed: dict[str, DataFrame]) -> None:
    for name in (*PARTS, *SETTINGS):
        if name in changed:
            changed[name].write.parquet(f"{after}/{name}")
        elif _there(spark, before, name):
            spark.read.parquet(f"{before}/{name}").write.parquet(f"{after}/{name}")


def keep_settings(spark: SparkSession, before: str, after: str) -> None:
    """Markings and ignored globs go along with what a run has learned since."""
    for name in SETTINGS:
        if _there(spark, before, name):
            spark.read.parquet(f"{before}/{name}").write.parquet(f"{after}/{name}")


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """(source, template_id, template, size) of the templates that the miner knows."""
    each = part(spark, folder, "miner").select("source", F.explode("clusters").alias("c"))
    return each.select("source", F.col("c.id").cast("string").alias("template_id"), F.array_join("c.template", " ").alias("template"), F.col("c.size").alias("size"))


def marked_templates(spark: SparkSession, folder: str, text: str = "", marking: str | None = None) -> DataFrame:
    """``templates`` with what they are marked as, the largest first; filters as of ``readapi.template_rows``."""
    return readapi.template_rows(templates(spark, folder), part(spark, folder, "markings"), text, marking)


def series(spark: SparkSession, folder: str, warmup: int = 30) -> DataFrame:
    """(series, samples, mean, std_dev, recent, warmup) of the series that the metric detector knows, the ones furthest off first."""
    known = part(spark, folder, "metrics")
    rows = known.select("series", F.col("n").alias("samples"), "mean", F.sqrt("variance").alias("std_dev"), F.col("fast").alias("recent"), (F.col("n") < warmup).alias("warmup"))
    return readapi.series_rows(rows)


def mark(spark: SparkSession, before: str, after: str, kind: str, name: str, marking: str | None) -> None:
    """Marks a ``template`` or a ``pattern`` of templates; None takes the marking away."""
    _written(spark, before, after, {"markings": readapi.mark(part(spark, before, "markings"), kind, name, marking)})


def ignore(spark: SparkSession, before: str, after: str, glob: str, ignored: bool = True) -> None:
    """Metrics or series that the glob fits learn but give no signals, or do so again."""
    others = part(spark, before, "ignored").filter(F.col("glob") != glob)
    _written(spark, before, after, {"ignored": others.union(spark.createDataFrame([(glob,)], IGNORED)) if ignored else others})


def forget_series(spark: SparkSession, before: str, after: str, glob: str) -> int:
    """Forgets the series that the glob fits, which begin anew if they come again; how many there were."""
    known = part(spark, before, "metrics")
    gone = known.filter(path_glob(F.col("series"), glob)).count()
    _written(spark, before, after, {"metrics": readapi.forget(known, "series", glob)})
    return gone


def forget_templates(spark: SparkSession, before: str, after: str, glob: str) -> int:
    """Forgets the templates that the glob fits, in miner and detector; how many there were."""
    gone = templates(spark, before).filter(text_glob(F.col("template"), glob)).count()
    fits = lambda text: text_glob(text, glob)
    miner = part(spark, before, "miner").withColumn("clusters", F.filter("clusters", lambda c: ~fits(F.array_join(c["template"], " "))))
    logs = part(spark, before, "logs").withColumn("templates", F.filter("templates", lambda t: ~fits(t["text"])))
    _written(spark, before, after, {"miner": miner, "logs": logs})
    return gone
