"""Tables in the folder that driver and executors share: where lineage ends, and where lost executors undo nothing."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where none is named, a session on one machine (master ``local``) gets a temporary one; on a cluster that is an
    error, since executors would write to their own disks and later reads would miss their rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing is at; ``clear_written`` clears it too."""
    return f"{_own_tables(spark)}/{uuid.uuid4().hex}"


def clear_written(spark: SparkSession) -> None:
    """Deletes what ``written`` has left; results that aren't computed yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends here, and lost executors don't undo it.

    Results are computed later from such tables, so they stay until ``clear_written`` or the folder's owner takes them away.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """``df`` with running sums over all rows in ``order``: ``sums`` names each and gives its column; a row counts in its own.

    Rows are dealt by ranges of ``order``, summed in each range, and ranges are set off by the sums of those before:
    no task sees more than a range, and what is ordered in one place is one row a range.
    """
    part, own = "_range", [f"_own_{name}" for name in sums]
    ranged = written(
        df.withColumns(dict(zip(own, sums.values(), strict=True))).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    )
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(c) for c in own])
    starts = totals.select(part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in own])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(starts), part)  # one row a range
    return joined.select(*df.columns, *[(F.col(f"{c}_before") + F.sum(c).over(inside)).alias(name) for c, name in zip(own, sums, strict=True)])


def carried(df: DataFrame, order: list[str], name: str, value: Column) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that isn't null of the rows before each in ``order``, null if there is none.

    ``order`` names columns, with ``-`` before those that fall.

    As ``running``, over ranges: what crosses from one to the next is one row a range.
    """
    part, own = "_range", "_own"
    onwards, back = ([F.col(c.lstrip("-")).asc() if c.startswith("-") == turned else F.col(c.lstrip("-")).desc() for c in order] for turned in (False, True))
    ranged = written(df.withColumn(own, value).repartitionByRange(*onwards).withColumn(part, F.spark_partition_id()))
    last = ranged.filter(F.col(own).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(part).orderBy(*back))).filter("_k = 1").select(part, F.col(own).alias("_last"))
    parts = ranged.select(part).distinct().join(last, part, "left")  # one row a range
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(part, F.last("_last", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy(part).orderBy(*onwards).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(starts), part)
    return joined.select(*df.columns, F.coalesce(F.last(own, ignorenulls=True).over(inside), F.col("_start")).alias(name))

