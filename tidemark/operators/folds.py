"""Ordered folds over keyed rows: state for one key at a time, whole groups are never held.

Rows are dealt by key and sorted inside each task, so a fold sees a key's rows in order and streams its
results.  The order within a key is what the operator is about, so a key can't be split over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.shared import written

BATCH_ROWS = 10_000


@dataclass(frozen=True)
class Resume:
    """A table of folds' states in the folder ``after``, one row a key, begun from that in ``before`` (none: from the start).

    Runs over parts of the rows, one part after the other in order, give together what one run over all rows gives.  Keys that
    a run has no rows of keep their state.  States are columns, as each fold's STATE names them, so tables of them can be read and
    edited as any others (``operators.state``).
    """

    after: str
    before: str | None = None


class Fold(Protocol):
    #: Columns of what the fold knows, for folds that runs or streams go on with.
    STATE: str

    def state(self) -> tuple: ...

    def restore(self, state: dict) -> None: ...

    def step(self, *row) -> Iterable[tuple]: ...

    def finish(self) -> Iterable[tuple]: ...


def map_rows(df: DataFrame, rows_of: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """``rows_of`` over the rows of each task, as tuples in and out, in Arrow batches."""
    out = StructType.fromDDL(ddl)
    schema = to_arrow_schema(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows_of(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            held.append(row)
            if len(held) >= BATCH_ROWS:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return df.mapInArrow(run, out)


def keyed_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], make: Callable[[], Fold], ddl: str, resume: Resume | None = None
) -> DataFrame:
    """Keys and what ``make()`` gives for ``columns`` of each key's rows in ``order``; ``ddl`` names the fold's columns.

    Times reach the fold as microseconds since 1970 if cast so before; ``micros`` does that.
    """
    if resume is not None:
        return _resumed_fold(df, keys, order, columns, make, ddl, resume)
    n = len(keys)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, fold = None, None
        for row in rows:
            if fold is None or row[:n] != now:
                if fold is not None:
                    yield from (now + out for out in fold.finish())
                now, fold = row[:n], make()
            yield from (now + out for out in fold.step(*row[n:]))
        if fold is not None:
            yield from (now + out for out in fold.finish())

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns)
    return map_rows(ordered, run, f"{kinds}, {ddl}")


def _resumed_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], make: Callable[[], Fold], ddl: str, resume: Resume
) -> DataFrame:
    """As ``keyed_fold``, the rows computed once and kept; folds aren't finished, since their keys go on."""
    n, width = len(keys), len(StructType.fromDDL(ddl))
    kind = StructType.fromDDL(make().STATE)
    names = kind.names

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, fold = None, None
        state = lambda: (*now, *(None,) * width, dict(zip(names, fold.state(), strict=True)))
        for row in rows:
            if fold is None or row[:n] != now:
                if fold is not None:
                    yield state()
                now, fold = row[:n], make()
                if row[n] is not None:
                    fold.restore(row[n])
            if row[n] is None:
                yield from ((*now, *out, None) for out in fold.step(*row[n + 1 :]))
        if fold is not None:
            yield state()

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.withColumn("_state", F.lit(None).cast(kind))
    if resume.before is not None:
        saved = df.sparkSession.read.parquet(resume.before).withColumn("_state", F.struct(*names)).drop(*names)
        rows = rows.unionByName(saved, allowMissingColumns=True)
    first = F.col("_state").isNull()  # a key's state goes before its rows
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, first, *order).select(*keys, "_state", *columns)
    both = written(map_rows(ordered, run, f"{kinds}, {ddl}, _state {kind.simpleString()}"))
    both.filter("_state is not null").select(*keys, "_state.*").write.mode("errorifexists").parquet(resume.after)
    return both.filter("_state is null").drop("_state")


def micros(column: str):
    """Microseconds since 1970 of a time, with or without a zone (taken as UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp")).alias(column)
