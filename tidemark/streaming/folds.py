"""The folds of the batch operators over streams: state lives in the state store, a row of typed columns for each key, which Spark's
state reader shows (``spark.read.format("statestore")``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.folds import Fold

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    """Rows within a state as dictionaries."""
    if isinstance(value, Row):
        return _plain(value.asDict())
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def _tuples(value):
    """Dictionaries within a state as tuples in the order of their columns."""
    if isinstance(value, dict):
        return tuple(map(_tuples, value.values()))
    return type(value)(map(_tuples, value)) if isinstance(value, (list, tuple)) else value


class FoldProcessor(StatefulProcessor):
    """Keeps a fold per key; the rows of a micro-batch are taken in order, batches as they come.

    A fold's state is bounded by the fold's own limits, as in batch; with ``ttl_s``, a key that isn't heard of for so long
    leaves the state store, and begins anew if it comes back.
    """

    def __init__(
        self, make: Callable[[], Fold], keys: Sequence[str], order: Sequence[str], columns: Sequence[str], names: Sequence[str], ttl_s: float | None = None
    ) -> None:
        self.make, self.keys, self.order, self.columns, self.names, self.ttl_s = make, keys, order, columns, names, ttl_s
        self.known = StructType.fromDDL(make().STATE).names  # while there is a session to ask

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {} if self.ttl_s is None else {"ttlDurationMs": int(self.ttl_s * 1000)}
        self.state = handle.getValueState("fold", self.make().STATE, **ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fold = self.make()
        if self.state.exists():
            fold.restore(_plain(dict(zip(self.known, self.state.get(), strict=True))))
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            for out in fold.step(*(row[c] for c in self.columns)):
                yield Row(**dict(zip(self.names, (*key, *out), strict=True)))
        self.state.update(_tuples(fold.state()))

    def close(self) -> None:
        pass


def stream_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], make: Callable[[], Fold], ddl: str, ttl_s: float | None = None
) -> DataFrame:
    """As ``keyed_fold``, over a streaming DataFrame; ``ttl_s``: seconds of processing time after which an idle key is forgotten."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{kinds}, {ddl}")
    processor = FoldProcessor(make, list(keys), list(order), list(columns), schema.names, ttl_s)
    return df.groupBy(*keys).transformWithState(processor, schema, "Append", "None" if ttl_s is None else "ProcessingTime")
