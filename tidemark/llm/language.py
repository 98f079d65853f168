"""Operator 5: language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that its code point alone seeds.  A trigram's vector binds
(multiplies) its letters' vectors, permuted (rotated) once for each place; a text's vector bundles (adds)
those of its trigrams; a language's prototype bundles the normalized vectors of its training texts.  A text
gets the language whose prototype has the largest cosine with its vector.

Training takes at most about ``TRAIN_ROWS`` labelled rows, drawn by a digest of the id; every text is
predicted from its whole self.  Words are lower-cased runs of letters, with a border at each end.

Prototypes are summed in whole numbers, so that they don't depend on the order in which parts arrive.

Defined results: a null text or one without a letter is ``und`` with score 0; so is all if nothing can be
learned; ties go to the first language by name; a null id is not held out and not learned from; repeated rows are
learned from, and predicted, each; a long text is bundled as a whole, pairs of letters by parts; columns other than
key, text and language don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table

DIMENSIONS, ORDER, SEED = 512, 3, 5
#: A normalized vector's numbers as whole ones.
SCALE = 1 << 30
TRAIN_ROWS = 20_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_CACHED_LETTERS, _CELLS, _DENSE_LETTERS = 20_000, 1 << 20, 128


class Encoder:
    """Vectors of texts; letters' vectors are made as they come."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions, self.letters = dimensions, {}

    def letter(self, c: str) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            if len(self.letters) >= _CACHED_LETTERS:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=[SEED, ord(c)])).integers(0, 2, self.dimensions)
            v = (2 * bits - 1).astype(np.float32)
            v = self.letters[c] = np.stack([np.roll(v, ORDER - 1 - place) for place in range(ORDER)])
        return v

    def encode(self, text: str | None) -> np.ndarray | None:
        """The bundle of all trigrams, or None without a letter."""
        words = LETTERS.findall((text or "").lower())
        if not words:
            return None
        run = " " + " ".join(words) + " "
        points, code = np.unique(np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
        letters = [chr(x) for x in points]
        if not any(map(str.isalpha, letters)):  # such as a superscript digit
            return None
        k = len(letters)
        first, second, third = np.moveaxis(np.stack([self.letter(c) for c in letters]), 1, 0)
        pairs, pair = np.unique(code[:-2] * k + code[1:-1], return_inverse=True)
        out = np.zeros(self.dimensions, np.float32)
        # a pair's vector multiplies the bundle of the letters that follow it
        step = max(1, _CELLS // max(k, self.dimensions))
        for at in range(0, len(pairs), step):
            own = (pair >= at) & (pair < at + step) if len(pairs) > step else slice(None)
            some = pairs[at : at + step]
            if k <= _DENSE_LETTERS:
                follow = np.bincount((pair[own] - at) * k + code[2:][own], minlength=len(some) * k).reshape(-1, k).astype(np.float32)
                bundles = follow @ third
            else:
                grams, n = np.unique((pair[own] - at) * k + code[2:][own], return_counts=True)
                bundles = np.zeros((len(some), self.dimensions), np.float32)
                np.add.at(bundles, grams // k, third[grams % k] * n[:, None].astype(np.float32))
            out += np.einsum("ij,ij,ij->j", first[some // k], second[some % k], bundles)
        return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one row each, of length 1."""
    rows = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)))
    n = rows.count()
    share = min(1.0, train_rows / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def bundle(parts: Iterator[tuple]) -> Iterator[tuple]:
        encoder, sums = Encoder(), {}
        for lang_, t in parts:
            v = encoder.encode(t)
            if v is not None and (norm := np.linalg.norm(v)):
                sums[lang_] = sums.get(lang_, 0) + np.rint(v.astype(np.float64) / norm * SCALE).astype(np.int64)
        for lang_, v in sums.items():
            yield from ((lang_, k, x) for k, x in enumerate(v.tolist()))

    sums = map_rows(drawn, bundle, "lang string, place int, x long").groupBy("lang", "place").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in sums]
    profiles = np.array([[x["x"] for x in r["v"]] for r in sums], np.float64).reshape(len(names), DIMENSIONS)
    return names, (profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def identify(docs: DataFrame, names: list[str], profiles: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast((names, profiles))  # DIMENSIONS numbers a language

    def of(parts: Iterator[tuple]) -> Iterator[tuple]:
        encoder, (langs, known) = Encoder(), model.value
        for key_, t in parts:
            v = encoder.encode(t)
            if v is None or not langs:
                yield key_, UNKNOWN, 0.0
                continue
            cosines = known @ (v / max(float(np.linalg.norm(v)), 1e-9))
            best = int(np.argmax(cosines))
            yield key_, langs[best], float(np.clip(cosines[best], 0.0, 1.0))

    return map_rows(rows, of, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, *learn(docs)).select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
