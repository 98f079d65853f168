"""Custom sources: a Python class becomes a Spark data source, batch and streaming.

``register(spark, name, schema, source)`` takes a class made with the options of the read.  A ``Partitioned`` source is read by tasks, a
partition each, between cursors of any text; the driver only asks where partitions end.  A ``Source`` has
``read(offset: int) -> (rows, next offset)``, offset 0 being the start; its stream is read on the driver, so it is for few rows.
Streams keep their offsets in the checkpoint, so that a restart resumes where they were.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader


class Source(Protocol):
    def __init__(self, options: dict[str, str]) -> None: ...

    def read(self, offset: int) -> tuple[Iterable[tuple], int]: ...


class Expired(Exception):
    """A source knows a cursor no longer, so what came after it can't be told from what came before."""


class Partitioned(Protocol):
    """A source of several partitions: files, topics, units, or the kinds of objects that a service lists and watches."""

    def __init__(self, options: dict[str, str]) -> None: ...

    def partitions(self) -> list[str]:
        """Their names as of now; more may come later, and are read from their start."""

    def latest(self, partition: str) -> str | None:
        """The cursor after all that is there, None if nothing is."""

    def read(self, partition: str, after: str | None, until: str | None) -> Iterable[tuple]:
        """Rows after a cursor, None being the start, up to another and no further; in a task.

        Raises ``Expired`` before its first row if it doesn't know ``after`` any more.  All up to ``until`` is listed again then, with None for
        ``after``: rows come at least once, and ids tell which came before.
        """


@dataclass
class _Span(InputPartition):
    name: str
    after: str | None
    until: str | None


def _span_rows(source: Partitioned, span: _Span) -> Iterator[tuple]:
    try:
        yield from source.read(span.name, span.after, span.until)
    except Expired:
        yield from source.read(span.name, None, span.until)


class _PartitionedBatch(DataSourceReader):
    def __init__(self, source: Partitioned) -> None:
        self.source = source

    def partitions(self) -> list[_Span]:
        ends = {name: self.source.latest(name) for name in self.source.partitions()}
        return [_Span(name, None, until) for name, until in ends.items() if until is not None]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return _span_rows(self.source, partition)


class _PartitionedStream(DataSourceStreamReader):
    def __init__(self, source: Partitioned) -> None:
        self.source = source

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: self.source.latest(name) for name in sorted(self.source.partitions())}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [_Span(name, start.get(name), until) for name, until in end.items() if until is not None and until != start.get(name)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return _span_rows(self.source, partition)


class _Batch(DataSourceReader):
    def __init__(self, source: Source) -> None:
        self.source = source

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(self.source.read(0)[0])


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, source: Source) -> None:
        self.source = source

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self.source.read(start["offset"])
        return iter(rows), {"offset": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["offset"]
        while at < end["offset"]:
            rows, after = self.source.read(at)
            yield from rows
            if after == at:
                return
            at = after


def register(spark: SparkSession, name: str, schema: str, source: type[Source] | type[Partitioned]) -> None:
    """Makes ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read from ``source``."""
    spark_name, spark_schema, kind = name, schema, source

    class Registered(DataSource):
        @classmethod
        def name(cls) -> str:
            return spark_name

        def schema(self) -> str:
            return spark_schema

    class OfPartitions(Registered):
        def reader(self, schema) -> DataSourceReader:
            return _PartitionedBatch(kind(dict(self.options)))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _PartitionedStream(kind(dict(self.options)))

    class Simple(Registered):
        def reader(self, schema) -> DataSourceReader:
            return _Batch(kind(dict(self.options)))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Stream(kind(dict(self.options)))

    spark.dataSource.register(OfPartitions if hasattr(source, "partitions") else Simple)
