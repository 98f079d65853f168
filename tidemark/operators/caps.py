"""Limits on how many keys are remembered, over all keys: the least recently seen are forgotten when a new one needs room.

What is remembered is always the most recently seen keys, so a key is forgotten by its next row if enough other keys came
in between.  Rows are dealt by ranges of their order.  What a range must know of those before it is the last keys seen, at most
the limit and one more; borders get it in rounds, each of which doubles how many ranges it reaches back.  A task then
counts, row by row, the keys seen since its key's last row (its distance).

If several keys go at once, how many are remembered also depends on when keys went before.  Once the limit has been reached, only
``drop`` numbers are possible, so each range tells what it makes of each of them, the ranges' maps are put one after the other
(a row a range), and each range then starts from the number that it really has.

Defined results: null keys are a key; equal times follow the rest of the order, then the keys; rows equal in all of these are one
key's anyway; a limit of 0 is none; an empty table gives an empty table; other columns don't matter, save that names with
``_cap`` in front are taken.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import keyed_fold, map_rows
from tidemark.shared import written

PART, LAST, DISTANCE, FRESH = "_cap_range", "_cap_last", "_cap_distance", "_cap_fresh"


class Recency:
    """How many other keys were seen since a key was; memory is in proportion to ``most``, however many rows come."""

    def __init__(self, most: int) -> None:
        self.most, self.room = most, 4 * most + 64
        self._restart([])

    def _restart(self, keys: list) -> None:
        self.at = {k: i for i, k in enumerate(keys, 1)}
        self.n = len(keys)
        self.tree = [0] * (self.room + 1)
        for i in range(1, self.n + 1):
            self._add(i, 1)

    def _add(self, i: int, by: int) -> None:
        while i <= self.room:
            self.tree[i] += by
            i += i & -i

    def _upto(self, i: int) -> int:
        out = 0
        while i:
            out += self.tree[i]
            i &= i - 1
        return out

    def seen(self, key, least: int = 0) -> int:
        """The distance, ``most`` if it is that or more or the key is new; 0 stands for all below ``least``."""
        if self.n == self.room:
            self._restart(sorted(self.at, key=self.at.__getitem__)[-self.most :])
        self.n += 1
        old, out = self.at.get(key), self.most
        if old is not None:
            out = 0 if self.n - old <= least else min(self.most, len(self.at) - self._upto(old))
            self._add(old, -1)
        self.at[key] = self.n
        self._add(self.n, 1)
        return 0 if out < least else out


class _Maps:
    """What a range makes of each number of remembered keys that it may begin with."""

    def __init__(self, most: int, drop: int) -> None:
        self.most, self.least, self.held = most, most - drop + 1, None

    def step(self, known: int, distance: int) -> Iterator[tuple]:
        if self.held is None:
            self.known = known
            self.held = np.array([known]) if known <= self.most else np.arange(self.least, self.most + 1)
        self.held += distance >= self.held
        self.held[self.held > self.most] = self.least
        return iter(())

    def finish(self) -> Iterator[tuple]:
        yield self.known, self.held.tolist()


class _Chain:
    """The number that each range begins with, from the ranges' maps in order."""

    def __init__(self, most: int, drop: int) -> None:
        self.most, self.least, self.held = most, most - drop + 1, 0

    def step(self, part: int, known: int, ends: list[int]) -> Iterator[tuple]:
        begins = known if known <= self.most else self.held
        yield part, begins
        self.held = ends[0] if known <= self.most else ends[begins - self.least]

    def finish(self) -> Iterator[tuple]:
        return iter(())


class _Fresh:
    """Rows of keys that aren't remembered, given the number at the range's begin."""

    def __init__(self, most: int, drop: int) -> None:
        self.most, self.drop, self.held = most, drop, None

    def step(self, begins: int, distance: int, *row) -> Iterator[tuple]:
        if self.held is None:
            self.held = begins
        fresh = distance >= self.held
        if fresh:
            self.held += 1 if self.held < self.most else 1 - self.drop
        yield (*row, fresh)

    def finish(self) -> Iterator[tuple]:
        return iter(())


def _latest(rows: DataFrame, by: str, keys: Sequence[str], most: int) -> DataFrame:
    """Of each ``by`` the last ``most`` keys, each with its last place."""
    one = rows.groupBy(by, *keys).agg(F.max(LAST).alias(LAST))
    return one.withColumn("_cap_k", F.row_number().over(Window.partitionBy(by).orderBy(F.col(LAST).desc()))).filter(F.col("_cap_k") <= most).drop("_cap_k")


def _borders(ranged: DataFrame, place: Column, keys: Sequence[str], most: int) -> DataFrame:
    """For each range, the last ``most`` keys of all ranges before it."""
    ends = ranged.agg(F.max(PART)).first()[0] or 0
    rows = _latest(ranged.select(PART, *keys, place.alias(LAST)), PART, keys, most).withColumn(PART, F.col(PART) + 1)
    reach, rows = 1, written(rows)
    while reach < ends:
        further = rows.withColumn(PART, F.col(PART) + reach)
        rows = written(_latest(rows.union(further).filter(F.col(PART) <= ends), PART, keys, most))
        reach *= 2
    return rows


def marked(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int, drop: int = 1, name: str = "fresh") -> DataFrame:
    """``df`` with ``name``: whether a row's key isn't remembered, ``most`` keys being so at most and ``drop`` going when one is too many.

    ``drop`` goes beyond 1 where room is made for several at a time.
    """
    if not 1 <= drop <= max(most, 1):
        raise ValueError("drop lies between 1 and most")
    if most <= 0 or df.select(*keys).distinct().count() <= most:  # room for all: nothing is ever forgotten
        return df.withColumn(name, F.lit(False))
    own = {c: f"_cap_c{i}" for i, c in enumerate(df.columns)}  # names of any kind come back at the end
    found = _marked(df.toDF(*own.values()), [own[k] for k in keys], [own[c] for c in order], most, drop)
    return found.select(*[F.col(c).alias(was) for was, c in own.items()], F.col(FRESH).alias(name))


def _marked(df: DataFrame, keys: list[str], order: list[str], most: int, drop: int) -> DataFrame:
    n, columns, least = len(keys), df.columns, most - drop + 1
    places = [*order, *[k for k in keys if k not in order]]
    place = F.struct(*places)
    ranged = written(df.repartitionByRange(*places).withColumn(PART, F.spark_partition_id()))
    before = _borders(ranged, place, keys, most + 1)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        part = recency = None
        known = 0
        for at, old, *row in rows:
            if at != part:
                part, recency, known = at, Recency(most), 0
            key, row = tuple(row[:n]), row[n:]
            if old:
                known += 1
                recency.seen(key)
            else:
                yield at, known, recency.seen(key, least), *row

    names = [f"_cap_key{i}" for i in range(n)]
    own = [F.col(k).alias(name) for k, name in zip(keys, names, strict=True)]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    of_rows = ranged.select(PART, F.lit(False).alias("_cap_old"), *own, place.alias(LAST), *columns)
    of_borders = before.select(PART, F.lit(True).alias("_cap_old"), *own, LAST, *none)
    dealt = of_rows.union(of_borders).repartition(PART).sortWithinPartitions(PART, F.col("_cap_old").desc(), LAST)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    placed = map_rows(dealt.select(PART, "_cap_old", *names, *columns), run, f"{PART} int, _cap_known int, {DISTANCE} int, {kinds}")
    if drop == 1:
        return placed.select(*columns, (F.col(DISTANCE) >= most).alias(FRESH))
    placed = written(placed)
    asked = placed.filter(F.col(DISTANCE) >= least)
    limits = (most, drop)
    maps = keyed_fold(asked, [PART], places, ["_cap_known", DISTANCE], lambda: _Maps(*limits), "_cap_begins int, _cap_ends array<int>")
    one = maps.withColumn("_cap_all", F.lit(0))  # a row a range
    begins = keyed_fold(one, ["_cap_all"], [PART], [PART, "_cap_begins", "_cap_ends"], lambda: _Chain(*limits), f"{PART} int, _cap_begins int").drop("_cap_all")
    found = keyed_fold(
        asked.join(F.broadcast(begins), PART), [PART], places, ["_cap_begins", DISTANCE, *columns], lambda: _Fresh(*limits), f"{kinds}, {FRESH} boolean"
    )
    return placed.filter(F.col(DISTANCE) < least).select(*columns, F.lit(False).alias(FRESH)).union(found.select(*columns, FRESH))
