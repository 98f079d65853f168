"""Operator 4: benchmark decontamination by BM25 retrieval with block-max WAND and an overlap check.

The test items are the indexed collection: postings by term, in blocks that know their largest impact.
Every passage of every text is a query: windows of twice the length of the longest item of a length class,
each starting in the middle of the one before, so that whole items lie in some window.  An item's impacts
are divided by its score against itself, so a passage's score is the share of the item that it holds, and
all items at ``THRESHOLD`` or more are retrieved.

Impacts are computed by Spark from document frequencies over all items.  One pass over all texts then adds up, for
each passage, the largest impact that each of its terms has in a block of items; these bounds are kept by a hash of
the term, in ``BUCKETS`` times ``MOST_BLOCKS`` numbers a class at most, whatever the benchmark's size.  Texts without a
passage that reaches the threshold in some block are done.  The few others are written, and searched in shards of
about ``SHARD_ITEMS`` items, which tasks build: smaller blocks rule out most of their passages, many at a time; for
the rest, block-max WAND skips items and blocks that can't reach the threshold.  A retrieved item counts if its question and its answer (its last sentence)
both overlap with the passage in word n-grams.  More items make more shards to go over the texts left, never another
pass over the corpus.

Defined results: null and empty texts and items match nothing; a pair of text and item is given once, with
its best passage; repeated rows and repeated items give the same pair once; of tied items all are given; a long text
is split into words as a whole, its passages are judged ``PASSAGES`` at a time; columns other than key and text
don't matter; without texts or without items nothing is found.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, row_identity, table, without_rows, written

K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION_OVERLAP, ANSWER_OVERLAP, NGRAM = 0.5, 0.5, 3
BLOCK, MOST_BLOCKS, SHORTEST_CLASS, SHARD_ITEMS = 8, 64, 32, 20_000
#: Passages of a text that are judged at once, and buckets of terms that share a bound.
PASSAGES, BUCKETS = 512, 1 << 18
#: What rounding may take from a sum.
SLACK = 1e-3

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_in(text: bytes) -> list[bytes]:
    """ASCII letters, lower-cased, digits, and all characters beyond ASCII; the rest divides words."""
    return text.translate(_KEEP).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of all sentences but the last, and of the last; of one sentence, the last fifth is the answer."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words_in(s.encode()))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 5
    return words[:cut], words[cut:]


def ngrams(words: list[bytes], n: int = NGRAM) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return set(zip(*[words[k:] for k in range(n)], strict=False)) if n else set()


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """The share of the n-grams of ``part`` that ``passage`` has; 1 if there is no part."""
    own = ngrams(part)
    return len(own & ngrams(passage, len(next(iter(own))))) / len(own) if own else 1.0


def first_places(at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each of the places ``at`` with their terms ``codes``: the term's place before, or -1."""
    order = np.argsort(codes, kind="stable")
    before = np.full(len(at), -1)
    same = codes[order][1:] == codes[order][:-1]
    before[order[1:][same]] = at[order[:-1][same]]
    return before


class Strides:
    """Passages over the indexed words of a text, by strides: passage k holds the strides k and k + 1; a term counts once a passage."""

    def __init__(self, stride: int, at: np.ndarray, codes: np.ndarray, before: np.ndarray, n_words: int) -> None:
        self.stride, self.codes, self.before, self.k = stride, codes, before, at // stride
        self.n = max(1, -(-n_words // stride) - 1)

    def runs(self) -> Iterator[tuple]:
        """PASSAGES at a time: (first passage, edges of the strides, slice of words, sum by passage of the impacts of these words)."""
        for low in range(0, self.n, PASSAGES):  # so that arrays of words by blocks don't grow with the text
            high = min(low + PASSAGES, self.n)
            edges = np.searchsorted(self.k, np.arange(low, high + 2))
            own = slice(edges[0], edges[-1])
            held, first = np.unique(self.k[own] - low, return_index=True)
            if not len(held):
                continue
            counted = [self.before[own] < (self.k[own] - back) * self.stride for back in (0, 1)]

            def sums(impact: np.ndarray, held=held, first=first, counted=counted, n=high - low) -> np.ndarray:
                # each stride by itself: differences of running sums would lose more the later a passage stands
                out = np.zeros((2, n + 1, impact.shape[1]))
                for side, counts in zip(out, counted, strict=True):
                    side[held] = np.add.reduceat(impact * counts[:, None], first, axis=0, dtype=np.float64)
                return out[0, :-1] + out[1, 1:]

            yield low, edges, own, sums


class BlockBounds:
    """``bound``: the largest impact of each term, a row, in each block of items, a column; row 0 is of no term."""

    def __init__(self, stride: int, bound: np.ndarray) -> None:
        self.stride, self.bound, self.most = stride, bound, bound.max(1)

    def passages(self, at: np.ndarray, codes: np.ndarray, before: np.ndarray, n_words: int) -> Iterator[tuple[int, list[int]]]:
        """(start, terms) of the passages that some block of items could bring to the threshold.

        ``at``, ``codes``: the places and terms of a text's indexed words; ``before``: each term's place before, or -1.
        """
        for low, edges, own, sums in Strides(self.stride, at, codes, before, n_words).runs():
            can = sums(self.most[codes[own]][:, None])[:, 0] >= THRESHOLD - SLACK
            if can.any():
                for start in np.flatnonzero(can & (sums(self.bound[codes[own]]) >= THRESHOLD - SLACK).any(1)):
                    yield (low + int(start)) * self.stride, list(dict.fromkeys(codes[edges[start] : edges[start + 2]].tolist()))


class Bounds:
    """Block bounds of all items by length class, of terms that share a bucket together."""

    def __init__(self, classes: dict[int, tuple[int, int]], entries: dict[str, np.ndarray], buckets: int = BUCKETS) -> None:
        """``classes``: stride and number of blocks; ``entries``: class, bucket, block and impact of each number that isn't 0."""
        used, row = np.unique(entries["bucket"], return_inverse=True)
        self.buckets, self.row = buckets, np.zeros(buckets, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.classes = []
        for c, (stride, blocks) in sorted(classes.items()):
            own, bound = entries["class"] == c, np.zeros((len(used) + 1, blocks), np.float32)
            np.maximum.at(bound, (row[own] + 1, entries["block"][own]), entries["impact"][own].astype(np.float32) + np.float32(1e-6))
            self.classes.append(BlockBounds(stride, bound))

    def may_match(self, text: bytes | None) -> bool:
        """Whether some passage of ``text`` could bring an item to the threshold."""
        words = words_in(text or b"")
        codes = self.row[np.fromiter(map(crc32, words), np.int64, len(words)) & (self.buckets - 1)]
        at = np.flatnonzero(codes)
        if not len(at):
            return False
        codes = codes[at]
        before = first_places(at, codes)
        return any(next(c.passages(at, codes, before, len(words)), None) for c in self.classes)


class Index(BlockBounds):
    """Items of one length class, (item, text, words and impacts); ``terms`` is shared by all classes."""

    def __init__(self, items: list[tuple[object, str, list[tuple[bytes, float]]]], terms: dict[bytes, int]) -> None:
        items = sorted(items, key=lambda x: str(x[0]))
        self.ids = [x[0] for x in items]
        self.parts = [question_and_answer(x[1]) for x in items]
        self.items: dict[int, list[int]] = defaultdict(list)
        self.impacts: dict[int, list[float]] = defaultdict(list)
        for at, (_, _, own) in enumerate(items):
            for w, x in own:
                self.items[terms[w]].append(at)
                self.impacts[terms[w]].append(x)
        # postings' blocks hold the items of so many numbers in a row; a term has its largest impact in each, 0 in the rest
        self.block = max(BLOCK, -(-len(items) // MOST_BLOCKS))
        bound = np.zeros((len(terms) + 1, -(-len(items) // self.block)), np.float32)
        for t, own in self.items.items():
            np.maximum.at(bound[t], np.array(own) // self.block, np.array(self.impacts[t], np.float32) + np.float32(1e-6))
        super().__init__(max(len(words_in(x[1].encode())) for x in items), bound)

    def search(self, terms: list[int]) -> Iterator[tuple[int, float]]:
        """(item, score) of all items at the threshold or more, by block-max WAND over the postings of ``terms``."""
        # [current item, term, place, largest impact, items, impacts, block maxima]
        lists = [[self.items[t][0], t, 0, float(self.most[t]), self.items[t], self.impacts[t], self.bound[t]] for t in terms if t in self.items]
        limit = THRESHOLD - 1e-9

        def seek(cursor: list, item: int) -> None:
            items, place = cursor[4], cursor[2]
            step = 1
            while place + step < len(items) and items[place + step] < item:
                step *= 2
            low, high = place + step // 2, min(place + step, len(items))
            while low < high:
                mid = (low + high) // 2
                if items[mid] < item:
                    low = mid + 1
                else:
                    high = mid
            cursor[2] = low
            cursor[0] = items[low] if low < len(items) else None

        while lists:
            lists.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, cursor in enumerate(lists):
                bound += cursor[3]
                if bound >= limit:
                    pivot = k
                    break
            if pivot is None:
                return
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum(c[6][block] for c in lists[: pivot + 1]) < limit:
                # no item of this block gets there before another list comes in
                target = (block + 1) * self.block
                if pivot + 1 < len(lists):
                    target = max(item + 1, min(target, lists[pivot + 1][0]))
                for cursor in lists[: pivot + 1]:
                    seek(cursor, target)
            elif lists[0][0] == item:
                score = sum(c[5][c[2]] for c in lists[: pivot + 1])
                if score >= limit:
                    yield item, score
                for cursor in lists[: pivot + 1]:
                    seek(cursor, item + 1)
            else:
                for cursor in lists[:pivot]:
                    if cursor[0] < item:
                        seek(cursor, item)
            lists = [c for c in lists if c[0] is not None]


class Shard:
    """The classes of a shard of items, over one vocabulary; ``items``: (class, item, text, words and impacts)."""

    def __init__(self, items: list[tuple[int, object, str, list[tuple[bytes, float]]]]) -> None:
        classes: dict[int, list] = defaultdict(list)
        self.terms: dict[bytes, int] = {}  # from 1; 0: in no item
        for c, *item in items:
            classes[c].append(tuple(item))
            for w, _ in item[2]:
                self.terms.setdefault(w, len(self.terms) + 1)
        self.classes = [Index(own, self.terms) for _, own in sorted(classes.items())]

    def matches(self, text: bytes | None) -> dict[object, tuple[float, float, float]]:
        """Best (score, question overlap, answer overlap) of each item that a passage of ``text`` holds."""
        out: dict[object, tuple[float, float, float]] = {}
        words = words_in(text or b"")
        codes = np.fromiter(map(self.terms.get, words, repeat(0)), np.int64, len(words))
        at = np.flatnonzero(codes)
        if not len(at):
            return out
        codes = codes[at]
        before = first_places(at, codes)
        for index in self.classes:
            for start, terms in index.passages(at, codes, before, len(words)):
                for k, score in index.search(terms):
                    question, answer = index.parts[k]
                    passage = words[start : start + 2 * index.stride]
                    q, a = overlap(question, passage), overlap(answer, passage)
                    if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                        out[index.ids[k]] = max(out.get(index.ids[k], (0.0, 0.0, 0.0)), (score, q, a))
        return out


def length_class(n_words: int) -> int:
    return max(SHORTEST_CLASS, 1 << (n_words - 1).bit_length())


def indexed_items(benchmark: DataFrame, item: str = "item_id", text: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(shard, class, n_words, item, text, terms: array<struct<word, impact>>) of the items that have a word, written.

    Impacts are BM25's, divided by the item's score against itself.
    """
    own = written(benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("text is not null").distinct().withColumn("no", F.monotonically_increasing_id()))
    n = own.count()
    shards = max(1, -(-n // shard_items))

    def counted(rows: Iterator[tuple]) -> Iterator[tuple]:
        for no, t in rows:
            words = words_in(t.encode())
            if words:
                tf: dict[bytes, int] = defaultdict(int)
                for w in words:
                    tf[w] += 1
                yield no, len(words), length_class(len(words)), [{"word": w, "tf": k} for w, k in tf.items()]

    items = written(map_rows(own.select("no", "text"), counted, "no long, n_words long, class long, tfs array<struct<word: binary, tf: long>>"))
    total = items.agg(F.sum("n_words")).first()[0] or 0
    each = items.select("no", "n_words", F.explode("tfs").alias("x")).select("no", "n_words", "x.*")
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    tf, n_words = F.col("tf"), F.col("n_words")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * n_words / (total / max(n, 1) or 1.0))
    scored = each.join(df, "word").withColumn("x", idf * tf * (K1 + 1) / (tf + norm))
    # an item's terms, in order, so that sums agree between runs
    gathered = scored.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("word", "x"))).alias("own"))
    whole = F.aggregate("own", F.lit(0.0), lambda acc, e: acc + e["x"])
    terms = F.transform("own", lambda e: F.struct(e["word"].alias("word"), (e["x"] / F.col("whole")).alias("impact")))
    gathered = gathered.withColumn("whole", whole).select("no", terms.alias("terms"))
    return written(
        own.join(gathered, "no").join(items.select("no", "n_words", "class"), "no")
        .select(F.pmod(F.xxhash64("item", "text"), F.lit(shards)).alias("shard"), "class", "n_words", "item", "text", "terms")
    )


def bounds_of(indexed: DataFrame, buckets: int = BUCKETS) -> Bounds:
    """What comes to the driver is bounded by buckets, blocks and length classes, however many items there are."""
    sizes = indexed.groupBy("class").agg(F.max("n_words").alias("stride"), F.count("*").alias("n")).collect()
    classes = {r["class"]: (r["stride"], min(MOST_BLOCKS, -(-r["n"] // BLOCK))) for r in sizes}
    blocks = F.coalesce(*[F.when(F.col("class") == c, F.lit(b)) for c, (_, b) in classes.items()], F.lit(1))
    each = indexed.select("class", F.pmod(F.xxhash64("item", "text"), blocks).alias("block"), F.explode("terms").alias("t"))
    most = each.groupBy("class", (F.crc32("t.word") % buckets).alias("bucket"), "block").agg(F.max("t.impact").alias("impact")).toArrow()
    return Bounds(classes, {c: most.column(c).to_numpy() for c in ("class", "bucket", "block", "impact")}, buckets)


def built_shards(indexed: DataFrame) -> DataFrame:
    """(shard, index): each shard built by a task, written."""

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(c, i, t, [(bytes(x["word"]), x["impact"]) for x in terms]) for c, i, t, terms in zip(frame["class"], frame["item"], frame["text"], frame["terms"], strict=True)]
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(Shard(rows))]})

    return written(indexed.groupBy("shard").applyInPandas(build, "shard long, index binary"))


def _matched(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """(key, t, u, item, score, question_overlap, answer_overlap): each row's matches; key, t and u are its identity."""
    spark = docs.sparkSession
    identity = [c.alias(n) for c, n in zip(row_identity(F.col(key), F.col(text)), ("key", "t", "u"), strict=True)]
    rows = docs.select(*identity, F.col(text).cast("binary").alias("text"))
    kinds = f"key {rows.schema['key'].dataType.simpleString()}, t long, u long"
    ddl = f"{kinds}, item {benchmark.schema[item].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"
    indexed = indexed_items(benchmark, item, item_text)
    bounds = spark.sparkContext.broadcast(bounds_of(indexed))
    shards = built_shards(indexed)

    def left(parts: Iterator[tuple]) -> Iterator[tuple]:
        for *own, text_ in parts:
            if bounds.value.may_match(text_):
                yield *own, text_

    texts = written(map_rows(rows, left, f"{kinds}, text binary", batch_rows=500))
    found = []
    for (shard,) in shards.select("shard").orderBy("shard").collect():  # numbers
        shared = spark.sparkContext.broadcast(shards.filter(F.col("shard") == shard).first()["index"])  # of SHARD_ITEMS items or about that

        def of(parts: Iterator[tuple], shared=shared) -> Iterator[tuple]:
            index = None
            for *own, text_ in parts:
                index = index or pickle.loads(shared.value)
                for item_, best in index.matches(text_).items():
                    yield *own, item_, *best

        found.append(map_rows(texts, of, ddl))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], ddl)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap) of the texts that hold a test item."""
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return _matched(docs, benchmark, key, text, item, item_text).groupBy("key", "item").agg(best).select("key", "item", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no test item; another row with their key doesn't count."""
    found = _matched(docs, benchmark, key, text, "item_id", "text")
    return without_rows(docs, row_identity(F.col(key), F.col(text)), found.select("key", "t", "u"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "score", "question_overlap", "answer_overlap"
    )
