"""Spelling variants: words one edit apart, found through Bloom filters that say which generated edits are words at all.

Every word generates its deletions of one code point and its replacements by a later one; insertions and replacements by an
earlier one are the same pairs seen from the other word.  Edits are generated as hashes only, by arithmetic on a polynomial hash, many words at once.
They are looked up in blocked Bloom filters, one for each length of words (a block is 512 bits, a look-up reads one block).  Filters are broadcast in passes
of at most ``PASS_BYTES``, which bounds what driver and tasks hold whatever the vocabulary; only edits that the filter knows are spelled out, and an
exact join with the vocabulary drops false positives.  A filter has no false negatives, so no pair is lost.

Null texts have no words, and a null id changes none; repeated rows count each; very long texts and words are taken whole.
Columns other than id and text don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table, written

#: Code points that words are made of, after lower-casing A-Z; edits use the same.
LETTERS = "".join(map(chr, (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))))
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One in so many runs loses a code point, by the contract.
DAMAGE = 199
#: Bits of filter a word (at five bits set, some 0.3 % of edits that are no words pass), bits of a block set a word, and bytes of filters in a pass.
BITS_A_WORD, SET, PASS_BYTES = 16, 5, 32 << 20
BLOCK_BYTES = 64
#: Different words that a task counts before it hands its counts on, and hashes that it has at once.
HELD, CELLS = 100_000, 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def counted_words(docs: DataFrame, key: str, text: str, letters: str = LETTERS, least_length: int = LEAST_LENGTH, damage: int = DAMAGE) -> DataFrame:
    """(word, n): runs of ``letters`` in the whole texts, A-Z lower-cased first, of ``least_length`` code points or more, and how often.

    With ``damage``, of runs whose crc32 with their document's id it divides, one code point goes first; 0: none.
    """
    runs = re.compile(f"[{re.escape(letters)}]{{{least_length},}}")

    def words(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: Counter[str] = Counter()
        for id_, body in rows:
            # bytes lower A-Z alone
            for run, n in Counter(runs.findall((body or "").encode().lower().decode())).items():
                if damage and id_ is not None and (h := zlib.crc32(f"{id_}:{run}".encode())) % damage == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= least_length:
                    held[run] += n
            if len(held) >= HELD:
                yield from held.items()
                held.clear()
        yield from held.items()

    return map_rows(docs.select(F.col(key).cast("string"), text), words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(length: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(length, _BASE), dtype=np.uint64)])


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length).astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths and positions of the words of that length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def hashes(words: list[str]) -> np.ndarray:
    """A word's hash: the sum of code points times powers of an odd base, modulo 2^64, scrambled."""
    out = np.zeros(len(words), np.uint64)
    for length, at in _by_length(words):
        out[at] = _mixed(_codes([words[k] for k in at], length) @ _powers(length)[:length])
    return out


def _block(h: np.ndarray, blocks: int | np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.asarray(blocks, dtype=np.uint64)) >> np.uint64(32)


def _bit(h: np.ndarray, k: int) -> np.ndarray:
    """The position from 0 to 511 that a hash, scrambled once more, sets in its block as the ``k``-th."""
    return (h >> np.uint64(9 * k)) & np.uint64(511)


def _blocks_of(n: int) -> int:
    return max(1, -(-n * BITS_A_WORD // (BLOCK_BYTES * 8)))


def filter_blocks(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(length, block, w0 to w7): the blocks of the filters of ``words`` that have a bit set; ``blocks``: how many by length."""
    names = [f"w{k}" for k in range(8)]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            h = hashes(own)
            length = np.fromiter(map(len, own), np.int64, len(own))
            block = _block(h, np.array([blocks[n] for n in length.tolist()], dtype=np.uint64))
            masks = np.zeros((len(own), 8), np.uint64)
            for k in range(SET):
                bit = _bit(_mixed(h + np.uint64(1)), k)
                masks[np.arange(len(own)), (bit >> np.uint64(6)).astype(int)] |= np.uint64(1) << (bit & np.uint64(63))
            yield pa.RecordBatch.from_arrays([length, block.astype(np.int64), *masks.view(np.int64).T.copy()], names=["length", "block", *names])

    ddl = "length long, block long, " + ", ".join(f"{c} long" for c in names)
    return words.select("word").mapInArrow(rows_of, ddl).groupBy("length", "block").agg(*[F.bit_or(c).alias(c) for c in names])


def _passes(blocks: dict[int, int], pass_bytes: int) -> list[list[tuple[int, int, int]]]:
    """Parts of filters (length, first block, end), gathered so that a pass's filters take ``pass_bytes`` at most."""
    most = max(1, pass_bytes // BLOCK_BYTES)
    parts = [(n, at, min(at + most, b)) for n, b in sorted(blocks.items()) for at in range(0, b, most)]
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for part in parts:
        size = part[2] - part[1]
        if size > room:
            out.append([])
            room = most
        out[-1].append(part)
        room -= size
    return out


def _known(h: np.ndarray, bits: np.ndarray, span: tuple[int, int], blocks: int) -> np.ndarray:
    """Positions of the sums ``h`` that the filter's part knows; ``bits``: the words of its blocks."""
    h = _mixed(h)
    block = _block(h, blocks).astype(np.int64)
    at = np.flatnonzero((block >= span[0]) & (block < span[1]))
    h, block = _mixed(h[at] + np.uint64(1)), block[at] - span[0]
    for k in range(SET):
        bit = _bit(h, k)
        hit = (bits[block, (bit >> np.uint64(6)).astype(int)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        at, h, block = at[hit], h[hit], block[hit]
    return at


def _edits(words: list[str], length: int, letters: np.ndarray, filters: dict, blocks: dict[int, int]) -> Iterator[tuple[str, str]]:
    """(word, edit) for the deletions and replacements by later letters that the filters know; words of one length."""
    powers = _powers(length)
    codes = _codes(words, length)
    terms = codes * powers[:length]
    upto = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    for span, bits in filters.get(length - 1, ()):
        for at in _known_in(upto[:, :-1] + (upto[:, -1:] - upto[:, 1:]) * _BASE_INVERSE, bits, span, blocks[length - 1]):
            w, i = divmod(at, length)
            yield words[w], words[w][:i] + words[w][i + 1 :]
    step = max(1, CELLS // max(1, len(words) * len(letters)))
    for lo in range(0, length, step):
        hi = min(lo + step, length)
        for span, bits in filters.get(length, ()):
            changed = (letters[None, None, :] - codes[:, lo:hi, None]) * powers[None, lo:hi, None] + upto[:, -1, None, None]
            later = (letters[None, None, :] > codes[:, lo:hi, None]).ravel()
            for at in _known_in(changed, bits, span, blocks[length], later):
                w, rest = divmod(at, (hi - lo) * len(letters))
                i, c = divmod(rest, len(letters))
                yield words[w], words[w][: lo + i] + chr(int(letters[c])) + words[w][lo + i + 1 :]


def _known_in(h: np.ndarray, bits: np.ndarray, span: tuple[int, int], blocks: int, asked: np.ndarray | None = None) -> list[int]:
    flat = h.ravel()
    at = np.arange(len(flat)) if asked is None else np.flatnonzero(asked)
    return at[_known(flat[at], bits, span, blocks)].tolist()


def near_words(words: DataFrame, letters: str = LETTERS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(a, b): both orders of every two of ``words`` (word) that differ by one inserted, deleted or replaced code point of ``letters``."""
    spark, own = words.sparkSession, words.select("word")
    counts = {r[0]: r[1] for r in own.groupBy(F.char_length("word").cast("int")).count().collect()}  # a row a length
    blocks = {length: _blocks_of(n) for length, n in counts.items()}
    stored = written(filter_blocks(own, blocks))
    alphabet = np.array(sorted(map(ord, letters)), dtype=np.uint64)
    found = []
    for parts in _passes(blocks, pass_bytes):
        wanted = reduce(lambda a, b: a | b, [(F.col("length") == n) & (F.col("block") >= lo) & (F.col("block") < hi) for n, lo, hi in parts])
        filters: dict[int, list] = {n: [] for n, _, _ in parts}
        for n, lo, hi in parts:
            filters[n].append(((lo, hi), np.zeros((hi - lo, 8), np.uint64)))
        rows = stored.filter(wanted).toArrow()  # at most pass_bytes
        at_length, at_block = rows["length"].to_numpy(), rows["block"].to_numpy()
        masks = np.stack([rows[f"w{k}"].to_numpy() for k in range(8)], axis=1).view(np.uint64)
        for n, spans in filters.items():
            for (lo, hi), bits in spans:
                mine = (at_length == n) & (at_block >= lo) & (at_block < hi)
                bits[at_block[mine] - lo] = masks[mine]
        sent = spark.sparkContext.broadcast(filters)

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for b in batches:
                every = b.column(0).to_pylist()
                for length, at in _by_length(every):
                    if length not in known and length - 1 not in known:
                        continue
                    few = max(1, CELLS // (max(length, 1) * len(alphabet)))
                    for k in range(0, len(at), few):
                        pairs = set(_edits([every[i] for i in at[k : k + few]], length, alphabet, known, blocks))
                        if pairs:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs, strict=True)], names=["a", "b"])

        reach = {n for n, _, _ in parts} | {n + 1 for n, _, _ in parts}
        asked = own.filter(F.char_length("word").isin(*reach)).repartition("word")
        found.append(asked.mapInArrow(probe, "a string, b string").join(own.withColumnRenamed("word", "b"), "b").select("a", "b"))
        if len(found) > 1:  # a pass ends before the next one's filters are made
            found = [written(reduce(DataFrame.union, found))]
    if not found:
        return spark.createDataFrame([], "a string, b string")
    pairs = written(reduce(DataFrame.union, found))
    return pairs.union(pairs.select("b", "a"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form): (word, root), the last that forms lead to from each word; forms run in no circle.  Each round doubles the way gone."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(words: DataFrame, letters: str = LETTERS, times: int = TIMES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``words`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is the most frequent of its near words (ties: the first in order of code points), if that is ``times`` as frequent or more; its
    root is the last that forms lead to, itself if it has none.
    """
    vocabulary = written(words.select("word", "n"))
    near = near_words(vocabulary, letters, pass_bytes)
    told = near.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = told.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("order"), "b")).alias("best"))
    both = vocabulary.join(best.withColumnRenamed("a", "word"), "word", "left")
    stands = -F.col("best.order") >= times * F.col("n")
    forms = written(both.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(stands, F.col("best.b")).alias("form"), F.when(stands, -F.col("best.order")).alias("form_n"),
    ))
    found = roots(forms.filter("form is not null"))
    return forms.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of ``documents`` that the contract counts."""
    words = counted_words(table(spark, sf_dir, "documents"), "doc_id", "text").filter(F.col("n") >= LEAST_COUNT)
    return spelling_variants(words)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB has no crc32, so its table of 256 numbers is built from the polynomial.
OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
         lambda h, b: xor(t[(xor(h, b) & 255) + 1], h >> 8), 4294967295::BIGINT)) AS h
  FROM each, crc
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
  ) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM holes a JOIN words b ON b.word = a.head || a.tail
  UNION
  SELECT b.word, a.word, a.n FROM holes a JOIN words b ON b.word = a.head || a.tail
), best AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS form_n FROM pairs GROUP BY a
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= {TIMES} * w.n THEN b.form_n END AS form_n,
         CASE WHEN b.form_n >= {TIMES} * w.n THEN (SELECT min(p.b) FROM pairs p WHERE p.a = w.word AND p.n = b.form_n) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word
), paths AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.root AND f.form IS NOT NULL
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p ON p.word = f.word JOIN forms l ON l.word = p.root AND l.form IS NULL
"""
