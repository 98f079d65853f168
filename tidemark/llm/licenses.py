"""Operator 2: license scans as an exact set-similarity join of text blocks with templates.

A block is a set of words.  A template is met where a block holds at least ``CONTAINMENT`` of its words.  Words are
ordered by how many lines of all texts have them, rarest first.  With m words in a template and t of them to be found,
one of its first m - t + 1 words must be among the block's first n - t + 1 (prefix filter; n counts the block's words
that any template has), n must reach t (length filter), and what stands behind two equal words must suffice (positional
filter).  Blocks and templates meet on such words alone; what is left is counted in full.

Lines are blocks, up to twice a template's length.  Since files wrap templates over lines and lines may be longer, whole
texts are joined with templates in the same way, and a text that holds enough of a template's words is cut into windows,
line feeds or not: twice as long as the template, each starting one length after the one before, so that a whole
template lies in one of them.

Common words strewn over a block aren't a notice, so ``ORDERED`` of the template's pairs of neighbouring words must
be neighbours in the block too; a replaced word takes two pairs.

Beside that, the base phrases are found wherever their words stand consecutively in the text.

Defined results: a null text is empty; rows that repeat an id and a text get the same result each; no labels make an
empty string; a long text is one row of words, cut into windows only for the templates whose words it holds; columns
other than key and text don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, table

#: Between words: ASCII other than letters and digits.  Texts are lower-cased before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Labels and notices that licenses give for use in works.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)
CONTAINMENT = 0.9
#: Share of a template's pairs of neighbouring words that must be neighbours in the block.
ORDERED = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, for words of ASCII letters; letters beyond ASCII may change among themselves.

    The two characters whose lower case is or has an ASCII letter take the slower way.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike("[Kİ]"), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))


def words_of(low: Column) -> Column:
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def phrase_places(low: Column, words: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """array<struct<at, label>>: where the words of a phrase stand consecutively."""
    none = F.array().cast("array<struct<at: bigint, label: string>>")

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")

        def here(i: Column) -> Column:
            out = words[i] == parts[0]
            for k, part in enumerate(parts[1:], 1):
                out &= words[i + k] == part
            return out

        found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
        found = F.transform(found, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))
        return F.when(low.rlike(BETWEEN.join(parts)) & (F.size(words) >= len(parts)), found).otherwise(none)

    return F.concat(*[of(*p) for p in phrases])


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # distinct, rarest first
    neighbours: tuple[str, ...]  # distinct pairs of words that follow each other
    length: int

    @property
    def needed(self) -> int:
        return math.ceil(CONTAINMENT * len(self.words) - 1e-9)

    @property
    def ordered(self) -> int:
        return math.ceil(ORDERED * len(self.neighbours) - 1e-9)

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.needed + 1]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def ranked_templates(templates: Sequence[tuple[str, str]], order: Sequence[str]) -> list[Template]:
    out = []
    for label, text in templates:
        words = template_words(text)
        out.append(Template(label, tuple(w for w in order if w in set(words)), tuple(sorted({f"{a} {b}" for a, b in zip(words, words[1:])})), len(words)))
    return out


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_any(low: Column, words: Sequence[str]) -> Column:
    """Whether one of ``words`` is in ``low``, be it as a part of a word; far quicker than a pattern of alternatives."""
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])


def word_ranks(lines: DataFrame, templates: Sequence[tuple[str, str]]) -> list[str]:
    """The templates' words by the number of ``lines`` (low) that have the word, then by name; counted over all lines."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    held = F.array_intersect(_strings(vocabulary), F.split("low", BETWEEN))
    counts = lines.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    by_word = {r["word"]: r["n"] for r in counts.collect()}  # words of templates only
    return sorted(vocabulary, key=lambda w: (by_word.get(w, 0), w))


def holding(blocks: DataFrame, ranked: Sequence[Template], order: Sequence[str]) -> DataFrame:
    """``blocks`` (low, others) with every template of which they hold enough words, once each: label, words, neighbours, t, m, ordered, length.

    Blocks meet templates on words of both prefixes; of the words that they share only the first one counts, and only it
    is asked for what may follow, so that no pair comes twice and nothing is shuffled.
    """
    spark, own = blocks.sparkSession, blocks.columns
    index = spark.createDataFrame(
        [(w, p, t.label, list(t.words), list(t.neighbours), t.needed, len(t.words), t.ordered, t.length) for t in ranked for p, w in enumerate(t.prefix)],
        "word string, p int, label string, words array<string>, neighbours array<string>, t int, m int, ordered int, length int",
    )
    starts, least = sorted({w for t in ranked for w in t.prefix}), min(t.needed for t in ranked)
    prefix = F.slice("own", F.lit(1), F.size("own") - least + 1)
    held = (
        blocks.withColumn("own", F.array_intersect(_strings(order), F.split("low", BETWEEN)))
        .filter(F.size("own") >= least)
        .select(*own, "own", F.size("own").alias("n"), F.explode(F.array_intersect(prefix, _strings(starts))).alias("word"))
        .withColumn("q", F.array_position("own", F.col("word")) - 1)
    )
    met = held.join(F.broadcast(index), "word")  # m - t + 1 rows a template
    bounds = F.expr("n >= t and q <= n - t and 1 + least(m - p - 1, n - q - 1) >= t")
    first = ~F.arrays_overlap(F.slice("words", F.lit(1), F.col("p")), "own")
    enough = F.size(F.array_intersect("own", "words")) >= F.col("t")
    return met.filter(bounds).filter(first & enough).select(*own, "label", "words", "neighbours", "t", "m", "ordered", "length")


def told(words: Column) -> Column:
    """Of a block's ``words``, in order, whether they are a notice of the template beside them and not its words strewn about."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    near = F.size(F.array_intersect("neighbours", F.coalesce(pairs, F.array().cast("array<string>"))))
    return (F.size(F.array_intersect("words", words)) >= F.col("t")) & (near >= F.col("ordered"))


def similar_blocks(lines: DataFrame, ranked: Sequence[Template], order: Sequence[str]) -> DataFrame:
    """``lines`` (id, th, at, low): (id, th, at, label, containment) of every line of at most twice a template's length that tells it."""
    starts = sorted({w for t in ranked for w in t.prefix})
    met = holding(lines.filter(has_any(F.col("low"), starts)), ranked, order)  # words of which these are parts drop out there
    words = words_of(F.col("low"))
    own = met.withColumn("block", words).filter((F.size("block") <= 2 * F.col("length")) & told(F.col("block")))
    return own.select("id", "th", "at", "label", (F.size(F.array_intersect("words", "block")) / F.col("m")).alias("containment"))


def wrapped_blocks(rows: DataFrame, ranked: Sequence[Template], order: Sequence[str]) -> DataFrame:
    """``rows`` (id, th, low): (id, th, at, label, containment) of every window that tells a template; ``at``: the line of the first of its words."""
    starts = sorted({w for t in ranked for w in t.prefix})
    met = holding(rows.filter(F.col("low").rlike("|".join(map(re.escape, starts)))), ranked, order)  # one look at the expression that lower-cases
    placed = F.flatten(F.transform(F.split("low", "\n"), lambda line, at: F.transform(words_of(line), lambda w: F.struct(at.alias("at"), w.alias("word")))))
    windows = let(
        placed, lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - F.col("length")), F.col("length")), lambda k: F.slice(ws, k, 2 * F.col("length")))
    )
    cut = met.select("id", "th", "label", "words", "neighbours", "t", "m", "ordered", F.explode(windows).alias("window"))
    block = F.transform("window", lambda w: w["word"])
    first = F.filter("window", lambda w: F.array_contains(F.col("words"), w["word"]))[0]["at"]
    found = F.size(F.array_intersect("words", block)) / F.col("m")
    return cut.filter(told(block)).select("id", "th", first.alias("at"), "label", found.alias("containment"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(key, n_words, places, matches) of every row: base phrases, and blocks (lines and windows) as array<struct<at, label, containment>>."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), lowered(F.col(text)).alias("low"))
    lines = rows.select("id", "th", F.posexplode(F.split("low", "\n")).alias("at", "low"))
    order = word_ranks(lines, templates)
    ranked = ranked_templates(templates, order)
    blocks = similar_blocks(lines, ranked, order).union(wrapped_blocks(rows, ranked, order))
    matches = blocks.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("at", "label", "containment"))).alias("matches"))
    both = let(words_of(F.col("low")), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), phrase_places(F.col("low"), w).alias("places")))
    base = rows.select("id", "th", both.alias("x")).select("id", "th", F.col("x.n").alias("n_words"), F.col("x.places").alias("places"))
    same = F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.th") == F.col("m.th"))
    return base.alias("b").join(matches.alias("m"), same, "left").select(F.col("b.id").alias("key"), "n_words", "places", "matches")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["at"])
    base = F.transform("places", lambda p: p["label"])
    own = F.coalesce(F.transform("matches", lambda m: m["label"]), F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def _values() -> str:
    return ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents
), w AS (
  SELECT doc_id, low, list_filter(string_split_regex(low, '{BETWEEN}'), lambda x: x <> '') AS ws FROM d
), p(label, parts) AS (VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])
), places AS (
  SELECT doc_id, label, i - 1 AS place
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0) x JOIN p ON ws[i] = parts[1] AND ws[i:i + len(parts) - 1] = parts
), base AS (
  SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), t AS (
  SELECT label, tl, list_distinct(tl) AS tw, len(tl) AS length, list_distinct(list_transform(generate_series(1, len(tl) - 1), lambda i: tl[i] || ' ' || tl[i + 1])) AS tn
  FROM (SELECT label, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS tl FROM (VALUES {_values()}) v(k, label, text))
), lines AS (
  SELECT doc_id, list_filter(string_split_regex(line, '{BETWEEN}'), lambda x: x <> '') AS bw FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM d)
), windows AS (
  SELECT doc_id, label, tw, tn, ws[k:k + 2 * length - 1] AS bw
  FROM (SELECT doc_id, ws, t.*, unnest(generate_series(1, greatest(1, len(ws) - length), length)) AS k FROM w JOIN t ON len(list_intersect(tw, ws)) >= ceil({CONTAINMENT} * len(tw) - 1e-9))
), b AS (
  SELECT doc_id, label, tw, tn, bw FROM windows
  UNION ALL SELECT doc_id, label, tw, tn, bw FROM lines JOIN t ON len(bw) <= 2 * length AND len(list_intersect(tw, bw)) >= ceil({CONTAINMENT} * len(tw) - 1e-9)
), found AS (
  SELECT doc_id, label, len(list_intersect(tw, bw)) / CAST(len(tw) AS DOUBLE) AS containment FROM b
  WHERE len(list_intersect(tw, bw)) >= ceil({CONTAINMENT} * len(tw) - 1e-9)
    AND len(list_intersect(tn, list_transform(generate_series(1, len(bw) - 1), lambda i: bw[i] || ' ' || bw[i + 1]))) >= ceil({ORDERED} * len(tn) - 1e-9)
), own AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""
