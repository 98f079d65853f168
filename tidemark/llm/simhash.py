"""Operator 6: SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 64 bits: each is 1 if set in over half of the XXH64 digests of its
shingles.  Distinct fingerprints are cut into two segments of 32 bits.  Of two fingerprints at
``radius`` 3 or less, one segment differs in 1 bit at most, so every fingerprint looks up the ball of
radius 1 around each of its segments in the table of segments, and whole distances decide.

Copies meet first: all later steps see each distinct fingerprint once.  Segment values that more than
``HOT`` fingerprints share would give pairs in the square of their number.  There the other segment is cut
into two of 16 bits, whose balls are enumerated in turn; inside one such bucket (48 bits given) the
fingerprints are linked by breadth-first search, which gives one link for each, not all pairs.

Defined results: a null text or one without words has fingerprint 0, linked like any other; a
component's id is its smallest doc_id, null only where all are; repeated rows are members like any.
Deletion goes by row (id and text), never by id alone; a long text is fingerprinted as a whole, a part of its shingles
at a time; columns of any other name come along; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import all_columns, row_identity, table, without_rows, written
from tidemark.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints with one segment value beyond which the value is refined, and values up to which their list is broadcast.
HOT, BROADCAST_HOT = 64, 100_000
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of the UTF-8 bytes of a text, as a signed 64-bit number."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, t, u, fp) of every row; key, t and u are its identity."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [0 if t is None else fingerprint(t, shingle) for t in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp, pa.int64())], names=["key", "t", "u", "fp"])

    identity = [c.alias(n) for c, n in zip(row_identity(F.col(key), F.col(text)), ("key", "t", "u"), strict=True)]
    rows = docs.select(*identity, F.col(text).alias("text"))
    return rows.mapInArrow(of, f"key {rows.schema['key'].dataType.simpleString()}, t bigint, u bigint, fp bigint")


def _segment(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value: Column, bits: int, mark: int) -> Column:
    """``value`` and each value with one of its zero bits set, all with the bits of ``mark``.

    Of two values that differ in one bit, the one that has 0 there finds the other.
    """
    masks = F.array(*[F.lit(1 << i).cast("bigint") for i in range(bits)])
    flips = F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m))
    return F.transform(F.concat(F.array(value), flips), lambda v: v.bitwiseOR(F.lit(mark).cast("bigint")))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _forest(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, fp): links (a, b) that join all fingerprints of a bucket that are linked."""

    def search(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        left = fps
        while len(left):
            root, left, queue = left[0], left[1:], [left[0]]
            while queue and len(left):
                near = np.bitwise_count(left ^ queue.pop()) <= RADIUS
                for x in left[near]:
                    yield int(root), int(x)
                queue.extend(left[near])
                left = left[~near]

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held["bucket"].iloc[-1] if len(held) else None
            done = held[held["bucket"] != last]
            held = held[held["bucket"] == last]
            yield linked(done)
        if held is not None:
            yield linked(held)

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        buckets = frame["bucket"].to_numpy()
        fps = frame["fp"].to_numpy().view(np.uint64)
        edges = np.flatnonzero(np.diff(buckets)) + 1
        for part in np.split(fps, edges) if len(fps) else ():
            if len(part) > 1 and len(own := np.unique(part)) > 1:
                out.extend(search(own))
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(runs, "a bigint, b bigint")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp, distinct, a written table): links (a, b) with the components of all pairs within RADIUS bits."""
    both = F.explode(F.array(*[F.struct(_segment(F.col("fp"), s).bitwiseOR(F.lit(s << 32).cast("bigint")).alias("key"), F.col("fp").alias("fp")) for s in (0, 1)]))
    held = nodes.select(both.alias("x")).select("x.key", "x.fp")
    ball = F.concat(*[_ball(_segment(F.col("fp"), s), 32, s << 32) for s in (0, 1)])
    asked = nodes.select("fp", F.explode(ball).alias("key"))
    hot = written(held.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"))
    n_hot = hot.count()
    cold = held
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
        cold = held.join(hot, "key", "left_anti")
    near = asked.withColumnRenamed("fp", "a").join(cold.withColumnRenamed("fp", "b"), "key").filter(
        (F.col("a") != F.col("b")) & (_distance("a", "b") <= RADIUS)
    )
    links = near.select("a", "b")
    if not n_hot:
        return links
    crowd = held.union(asked.select("key", "fp")).join(hot, "key", "left_semi").distinct()
    other = F.when(F.shiftrightunsigned(F.col("key"), 32) == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    crowd = crowd.withColumn("other", other)
    halves = (F.shiftrightunsigned(F.col("other"), 16), F.col("other").bitwiseAND(F.lit(0xFFFF)))
    # key has 33 bits, a half 16; the bit between tells the halves apart
    buckets = F.concat(*[F.transform(_ball(h, 16, j << 16), lambda v: F.shiftleft(F.col("key"), 17).bitwiseOR(v)) for j, h in enumerate(halves)])
    return links.union(_forest(crowd.select("fp", F.explode(buckets).alias("bucket"))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, t, u, fp, component, first) of every row; ``component`` is the smallest key that links lead to.

    ``first``: whether the row is its component's first by key, nulls last, then by the text's digest; only rows with equal keys and texts share it.
    """
    prints = written(fingerprints(docs, key, text, shingle))
    own = F.struct(F.col("key").isNull().alias("nul"), "key", "t", "u")
    nodes = written(prints.groupBy("fp").agg(F.min(own).alias("least")))
    roots = written(components(fingerprint_links(nodes.select("fp"))))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("least"))
    named = placed.drop("least").join(least, "root").select(F.col("fp").alias("of"), "least")
    return prints.join(named, prints["fp"] == named["of"]).select("key", "t", "u", "fp", F.col("least.key").alias("component"), own.eqNullSafe(F.col("least")).alias("first"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each component of ``docs``: that with the smallest key, nulls last, of equal keys that with the smallest digest.

    Rows that repeat a key and a text are one document, and all are treated alike.  Rows without a key are documents each: of equal ones, one stays.
    """
    identity = row_identity(F.col(key), F.col(text))
    kept = without_rows(docs, identity, near_duplicates(docs, key, text).filter(~F.col("first")).select("key", "t", "u"))
    unnamed = kept.filter(F.col(key).isNull()).select(identity[1].alias("t"), identity[2].alias("u"), F.struct(*all_columns(docs)).alias("row"))
    one = unnamed.groupBy("t", "u").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.filter(F.col(key).isNotNull()).union(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
