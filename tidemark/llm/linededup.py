"""Operator 1: line dedup over the whole corpus by a deletion-neighbourhood join.

A line with a word is compared as its lower-cased words.  It is removed if an earlier line (by doc_id,
nulls last, then by the text's digest and the line's place) has the same words or is within its edit bound.
The bound is one unit, put in, left out or changed, for a line of ``min_units`` units or more: a word where the longer
line has so many words, else a character where both have fewer and the longer has so many characters.  Lines of fewer
characters must be equal; with ``min_units`` 1 no line must.  It doesn't matter whether the earlier line is itself
removed.

Equal lines meet by digest, and only the distinct ones go on.  A line within one edit of another shares
with it all before or all after the middle, so lines that share neither half with another are done.  Each
line left emits its deletion neighbourhood as hashed keys: its units without the i-th, once with i (lines
that share such a key differ in the i-th unit at most) and once without (a line that has just these units
is one unit shorter).  In either case the smallest line of a key stands for the rest, so that keys give
links in proportion to their lines, not all pairs.  Word-level or character-level edit distance then decides.

Lines go through all this as digests.  Those left after the halves are spelled by a second pass over the texts,
which finds the place that each has by a Bloom filter of ``BLOOM_BITS``, whatever the size of the corpus, and an
exact join of what passes it.  More lines than the filter has room for make more lines pass, never fewer.

Defined results: a null text has no lines; rows that repeat an id and a text are one document, and all
are treated alike; lines without a word are no lines, and go only where another line goes; long lines emit a key
for each unit in time proportional to their units; columns of ``docs`` of any name come along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import all_columns, dealt, let, map_rows, table, trimmed, written

MIN_UNITS = 10
#: Bits of the filter of places, a constant 8 MB, and how many each place sets.
BLOOM_BITS, BLOOM_PROBES = 1 << 26, 4
_ROW = "nul boolean, id {kind}, th bigint"
_BATCH = 20_000
WORDS, CHARS = 0, 1
#: Keys are sums of units' hashes times powers of a base, modulo a prime, so that leaving a unit out takes two products.
_PRIME = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 % _PRIME
_INVERSE = pow(_BASE, -1, _PRIME)


def _two(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def text_digest(text: bytes) -> int:
    """As Spark's xxhash64 of the text."""
    x = xxhash.xxh64_intdigest(text, 42)
    return x - (1 << 64) if x >> 63 else x


def _lines(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place and words of every line that has a word; A-Z are lower-cased."""
    for at, line in enumerate(text.split(b"\n")):
        words = line.lower().split()
        if words:
            yield at, words


def _views(words: list[bytes], min_units: int) -> Iterator[tuple[int, list[bytes]]]:
    """The line as units that it can be within an edit of another by: words, characters, or for the border both."""
    if len(words) >= min_units - 1:
        yield WORDS, words
    if len(words) < min_units:
        chars = [c.encode("utf-8", "surrogateescape") for c in b" ".join(words).decode("utf-8", "surrogateescape")]
        if len(chars) >= min_units - 1:
            yield CHARS, chars


def _halves(view: int, units: list[bytes]) -> list[int]:
    """Keys of the units before and after the middle, for both lengths that the shorter line of a pair can have.

    The lowest bits of a key tell its kind: the first is set for the units after the middle, the second is the view.
    """
    n, between, out = len(units), b"\0", []
    for shorter in (n, n - 1):
        half, tag = shorter // 2, b"%d:" % shorter
        for side, part in ((0, units[:half]), (1, units[n - (shorter - half) :])):
            h = xxhash.xxh3_64_intdigest(tag + between.join(part)) - (1 << 63)
            out.append((h & ~3) | view << 1 | side)
    return out


def _neighbourhood(view: int, units: list[bytes], front: bool, back: bool, min_units: int) -> Iterator[tuple[int, int]]:
    """(key, role): role 0 for the line's own units, 1 for a deletion, 2 for a deletion at a known place.

    ``front`` and ``back``: whether the edit can lie before or after the middle.
    """
    n, digest = len(units), xxhash.xxh3_64_intdigest
    terms, power = [], 1
    for u in units:
        terms.append(digest(u) % _PRIME * power % _PRIME)
        power = power * _BASE % _PRIME
    total = sum(terms) % _PRIME
    mark = view << 62  # of the two kinds of key, and of the views
    yield (total ^ mark) - (1 << 63), 0
    if n < min_units:  # such a line can only be the shorter one
        return
    low, high = (0 if front else (n - 1) // 2), (n if back else n // 2 + 1)
    before = sum(terms[:low]) % _PRIME
    for i in range(low, high):
        upto = (before + terms[i]) % _PRIME
        rest = (before + (total - upto) * _INVERSE) % _PRIME
        before = upto
        yield (rest ^ mark) - (1 << 63), 1
        yield digest(b"%d:%d:%d" % (view, i, rest)) - (1 << 63) | 1 << 61, 2


def within_one_edit(a: list, b: list) -> bool:
    """Whether the edit distance of two lists is 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def near(a: str, b: str, min_units: int = MIN_UNITS) -> bool:
    """Whether two lines, words divided by one space, are within the edit bound."""
    x, y = a.split(" "), b.split(" ")
    if max(len(x), len(y)) >= min_units:
        return within_one_edit(x, y)
    return max(len(a), len(b)) >= min_units and within_one_edit(list(a), list(b))


def _over_lines(texts: DataFrame, ddl: str, rows_of: Callable[[object, int, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows that ``rows_of(id, digest of text, text)`` gives of each text."""

    def of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for id_, text in rows:
            if text is not None:
                yield from rows_of(id_, text_digest(text), text)

    return map_rows(texts.select("id", F.col("text").cast("binary").alias("text")), of, ddl)


class Bloom:
    """Places (th, at) of lines; what was added is found, and little else while there is room."""

    def __init__(self, bits: int = BLOOM_BITS) -> None:
        self.bits, self.words = bits, np.zeros(bits >> 6, np.uint64)

    def probes(self, th, at) -> np.ndarray:
        """Bits of each place: a row a probe."""
        with np.errstate(over="ignore"):
            h = np.asarray(th).astype(np.int64).view(np.uint64) ^ (np.asarray(at).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            step = (h >> np.uint64(32)) | np.uint64(1)
            k = np.arange(BLOOM_PROBES, dtype=np.uint64)[:, None]
            return (h + k * step) % np.uint64(self.bits)

    def add(self, th, at) -> None:
        bit = self.probes(th, at).ravel()
        np.bitwise_or.at(self.words, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))

    def has(self, th, at) -> np.ndarray:
        bit = self.probes(th, at)
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).all(0)


def bloom_of(places: DataFrame, bits: int = BLOOM_BITS) -> Bloom:
    """The filter of ``places`` (th, at), made by the tasks; its words, a constant number, come to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits)
        for b in batches:
            own.add(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(own.words)
        for at in range(0, len(used), _BATCH):
            some = used[at : at + _BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own.words[some].view(np.int64))], names=["word", "bits"])

    words = places.select("th", "at").mapInArrow(part, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got, out = words.toArrow(), Bloom(bits)
    out.words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _first() -> Column:
    return F.min(F.struct("nul", "id", "th", "at")).alias("first")


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_units: int = MIN_UNITS) -> DataFrame:
    """(nul, id, th, at): the lines that stay, each once; th is the digest of the text."""
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    row = _ROW.format(kind=kind)

    def all_lines(id_, th: int, t: bytes) -> Iterator[tuple]:
        for at, words in _lines(t):
            a, b = _two(xxhash.xxh3_128_digest(b" ".join(words)))
            halves = [h for view in _views(words, min_units) for h in _halves(*view)]
            yield (a, b, id_ is None, id_, th, at, halves or None)

    occurrences = _over_lines(texts, f"a bigint, b bigint, {row}, at int, halves array<bigint>", all_lines)
    lines = written(occurrences.groupBy("a", "b").agg(_first(), F.first("halves").alias("halves")))

    halves = lines.filter("halves is not null").select("a", "b", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    # a line's bits: (edit before the middle, edit after it) by words, by characters; the edit is not in the half that is shared
    place = F.expr("shiftleft(1, cast((half & 2) + 1 - (half & 1) as int))")
    live = written(
        halves.join(shared, "half", "left_semi").groupBy("a", "b").agg(F.bit_or(place).alias("edits")).join(lines.select("a", "b", "first"), ["a", "b"])
    )
    firsts = lines.select("a", "b", "first")
    if live.head(1):
        firsts = firsts.join(_near_lines(texts, live, row, min_units), ["a", "b"], "left_anti")
    return firsts.select("first.nul", "first.id", "first.th", "first.at")


def _spelled(texts: DataFrame, live: DataFrame, row: str) -> DataFrame:
    """``live`` with ``line``: its words divided by one space."""
    filter_ = texts.sparkSession.sparkContext.broadcast(bloom_of(live.select("first.th", "first.at"), BLOOM_BITS))

    def some(id_, th: int, t: bytes) -> Iterator[tuple]:
        own = list(_lines(t))
        if not own:
            return
        hit = filter_.value.has(np.full(len(own), th), np.array([at for at, _ in own]))
        for k in np.flatnonzero(hit):
            at, words = own[k]
            yield (id_ is None, id_, th, at, b" ".join(words).decode("utf-8", "replace"))

    passed = _over_lines(texts, f"{row}, at int, line string", some)
    same = F.col("p.th").eqNullSafe(F.col("l.first.th")) & (F.col("p.at") == F.col("l.first.at")) & F.col("p.id").eqNullSafe(F.col("l.first.id"))
    # rows that repeat an id and a text give a line again
    return passed.alias("p").join(live.alias("l"), same).select("a", "b", "first", "edits", "line").dropDuplicates(["a", "b"])


def _near_lines(texts: DataFrame, live: DataFrame, row: str, min_units: int) -> DataFrame:
    """(a, b) of the live lines that an earlier one within the bound goes before."""
    found = written(_spelled(texts, live, row))

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["a", "b", "key", "role"]
        for frame in frames:
            out = []
            for a, b, line, edits in frame.itertuples(index=False, name=None):
                for view, units in _views(line.encode().split(b" "), min_units):
                    front, back = edits >> (2 * view) & 1, edits >> (2 * view + 1) & 1
                    if not (front or back):
                        continue
                    for k, role in _neighbourhood(view, units, front, back, min_units):
                        out.append((a, b, k, role))
                        if len(out) >= _BATCH:
                            yield pd.DataFrame(out, columns=names)
                            out = []
            yield pd.DataFrame(out, columns=names)

    emitted = written(dealt(found.select("a", "b", "line", "edits")).mapInPandas(keys, "a bigint, b bigint, key bigint, role int"))
    # a key matters if two lines meet in it; deletions without a place need the line that is one unit shorter
    met = (
        emitted.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("role").alias("least"))
        .filter("n > 1 and (least = 0 or least = 2)")
        .select("key")
    )
    members = written(
        emitted.join(met, "key", "left_semi").join(found.select("a", "b", "first"), ["a", "b"]).select("key", "role", F.struct("first", "a", "b").alias("line"))
    )
    heads = members.groupBy("key").agg(
        F.min(F.when(F.col("role") == 0, F.col("line"))).alias("own"), F.min(F.when(F.col("role") != 0, F.col("line"))).alias("other")
    )
    pairs = (
        members.join(heads, "key")
        .select(F.col("line").alias("later"), F.when(F.col("role") == 1, F.col("own")).otherwise(F.col("other")).alias("earlier"))
        .filter("earlier.first < later.first")
        .select("later.a", "later.b", F.col("earlier.a").alias("ea"), F.col("earlier.b").alias("eb"))
        .distinct()
    )
    texts_of = found.select("a", "b", "line")
    both = pairs.join(texts_of, ["a", "b"]).join(
        texts_of.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("line").alias("eline")), ["ea", "eb"]
    )

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [near(x, y, min_units) for x, y in zip(frame["line"], frame["eline"], strict=True)]
            yield frame.loc[good, ["a", "b"]]

    return both.select("a", "b", "line", "eline").mapInPandas(verified, "a bigint, b bigint").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_units: int = MIN_UNITS) -> DataFrame:
    """``docs`` with lines removed, plus n_lines and n_kept (lines that have a word, before and after).

    A text of which nothing goes is unchanged; else the lines that stay are joined by line feeds.
    Columns of ``docs`` named n_lines or n_kept give way.
    """
    per = kept_lines(docs, key, text, min_units).groupBy("nul", "id", "th").agg(F.sort_array(F.collect_list("at")).alias("kept"))
    rows = docs.select(
        F.struct(*all_columns(docs)).alias("row"), F.col(key).alias("rid"), F.col(text).alias("t"), F.xxhash64(text).alias("rth")
    )
    joined = rows.join(per, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rth") == F.col("th")), "left")
    lines = F.split(F.coalesce(F.col("t"), F.lit("")), "\n")
    n_lines = F.size(F.filter(lines, lambda line: trimmed(line) != ""))
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    new = F.when(F.size(kept) == F.col("n_lines"), F.col("t")).otherwise(
        let(lines, lambda ls: F.array_join(F.transform(kept, lambda at: ls[at]), "\n"))
    )
    out = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("n_kept", F.size(kept).cast("long"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    return out.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in own], "n_lines", "n_kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("kept_sha256"))
