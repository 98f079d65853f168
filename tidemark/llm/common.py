"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.shared import clear_written, running, written  # noqa: F401  (for the operators)

#: Spaces between words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """The words between white space; null and blank texts have none."""
    return let(
        trimmed(F.coalesce(text, F.lit(""))),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE)),
    )


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` under their own names, dots and quotes among them."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores where it comes in fewer pieces than half of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; small files come in few pieces."""
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Rows that Python operators gather before they hand a batch on.
BATCH_ROWS = 10_000


def map_rows(df: DataFrame, rows_of: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``rows_of`` over the rows of each partition, in order, as tuples in and out; strings come as str."""
    out = StructType.fromDDL(ddl)
    schema = to_arrow_schema(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows_of(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            held.append(row)
            if len(held) >= batch_rows:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return df.mapInArrow(run, out)


#: Bytes up to which a list of rows' identities is broadcast, after they were summed, and bytes of one beside its key.
BROADCAST_BYTES, IDENTITY_BYTES = 32 << 20, 64


def row_identity(key: Column, text: Column) -> list[Column]:
    """What tells documents apart, ids being neither unique nor always there: the key and 128 bits of the text's digest, to be matched null-safe."""
    return [key, F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def without_rows(df: DataFrame, identity: list[Column], gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``identity`` isn't among the rows of ``gone`` (a column for each part); nulls are equal.

    Up to BROADCAST_BYTES of rows gone, the texts of ``df`` stay where they are; beyond, both sides are dealt by identity.
    """
    name = "_gone"
    while any(c.startswith(name) for c in df.columns):
        name += "_"
    names = [f"{name}{k}" for k in range(len(identity))]
    rows = written(gone.toDF(*names).distinct())
    n, keys = rows.agg(F.count("*"), F.sum(F.octet_length(F.col(names[0]).cast("string")))).first()
    few = n * IDENTITY_BYTES + (keys or 0) <= BROADCAST_BYTES
    same = reduce(Column.__and__, [part.eqNullSafe(F.col(n)) for part, n in zip(identity, names, strict=True)])
    return df.join(F.broadcast(rows) if few else rows, same, "left_anti")
