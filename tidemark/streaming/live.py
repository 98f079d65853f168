"""Live events: the newest that are there first, a marker, and then each that comes, once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.readapi import NEWEST

RECENT, MARKER, LIVE = "recent", "marker", "live"
_OUT = "n long, what string, id string, body string"


class _Live(StatefulProcessor):
    """Remembers the newest ids, so that an event that comes again within so many isn't told again."""

    def __init__(self, newest: int) -> None:
        self.newest = newest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "us long, id string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = [tuple(r) for r in self.known.get()] if self.known.exists() else []
        seen, new = {i for _, i in known}, {}
        for r in rows:
            if r.id not in seen and r.id not in new:
                new[r.id] = (r.us, r.id, r.body)
                if len(new) >= 4 * self.newest and not self.count.exists():
                    # before the marker only the newest count, so no more than these are held
                    new = {x[1]: x for x in sorted(new.values())[-self.newest :]}
        order = sorted(new.values())
        n = self.count.get()[0] if self.count.exists() else None
        out = []
        if n is None:
            order, n = order[-self.newest :], 0
            out = [Row(n=k, what=RECENT, id=i, body=b) for k, (_, i, b) in enumerate(order)] + [Row(n=len(order), what=MARKER, id=None, body=None)]
        else:
            out = [Row(n=n + k, what=LIVE, id=i, body=b) for k, (_, i, b) in enumerate(order)]
        self.count.update((n + len(out),))
        self.known.put(sorted([*known, *((us, i) for us, i, _ in order)])[-self.newest :])
        return iter(out)

    def close(self) -> None:
        pass


def live(events: DataFrame, newest: int = NEWEST) -> DataFrame:
    """(n, what, id, body) of streamed ``events`` (id string, ts, ...): in the first micro-batch the ``newest`` of what is there, oldest first, and a
    marker; from then on every event once, if it isn't among the ``newest`` that came before.

    ``n`` counts on in the order in which rows are to be shown; ``body`` is the event as JSON.  One key holds the state, ``newest`` ids.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    rows = events.select(us, "id", F.to_json(F.struct(*events.columns)).alias("body")).withColumn("all", F.lit(0))
    return rows.groupBy("all").transformWithState(_Live(newest), StructType.fromDDL(_OUT), "Append", "None")
