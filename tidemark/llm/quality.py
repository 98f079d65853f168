"""Operator 10: quality rules as a short-circuit cascade.

Each rule rejects a text by a few features of it.  The cascade estimates every rule's cost (the work that its
features take over the texts of a sample) and selectivity (the share that it rejects of it) and orders the rules
by rejection per cost, so that a text is dropped by the cheapest likely rule and later features are never computed
for it.  The order changes only the work, never the verdict: a text is kept if no rule rejects it.

Work is counted, in units of which each feature takes so many nanoseconds (``WORK``), not timed: timings of some
hundred rows are mostly those of starting a job, and order rules anew in every run.

Defined results: a null text is an empty one (no words: rejected as too short); extra columns of any name,
null ids and repeated rows pass through untouched; of tied rules the first listed comes first, which changes no
verdict; a long text is held as its words once; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, table, trimmed, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: trimmed(line) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line."""
    return let(lines_with_words(text), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def repeated_words(w: Column) -> Column:
    """Words that stand in a window of five words found twice or more in the text."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
    # only of texts in which two windows hash alike the windows themselves are compared
    spelled = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("text"), i.alias("at")))

    def twice(s: Column) -> Column:
        equal = lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["text"] == e["text"])) | (
            (k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["text"] == e["text"])
        )
        return F.sort_array(F.transform(F.filter(s, equal), lambda e: e["at"]))

    step = lambda acc, at: F.struct(
        (acc["n"] + at + WINDOW - F.greatest(acc["end"], at)).cast("long").alias("n"), (at + WINDOW).cast("int").alias("end")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = let(F.sort_array(spelled), lambda s: F.aggregate(twice(s), zero, step)["n"])
    any_twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(w) > WINDOW, F.when(any_twice, covered).otherwise(F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def stutters(w: Column) -> Column:
    """Words that equal the word before."""
    return F.when(F.size(w) > 1, F.size(F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: w[i] == w[i - 1]))).otherwise(0)


#: Every feature is an expression of the text and its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")),
    "n_symbols": lambda t, w: F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")),
    "n_lines": lambda t, w: F.size(lines_with_words(t)),
    "n_dup_lines": lambda t, w: duplicate_lines(t),
    "n_repeat_words": lambda t, w: repeated_words(w),
    "n_shouts": lambda t, w: F.regexp_count(t, F.lit("!!+")),
    "n_stutters": lambda t, w: stutters(w),
}


#: Nanoseconds that a feature takes of a text and its words, by what it goes over: characters or words.
WORK: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.lit(10),
    "word_chars": lambda t, w: 50 * F.length(t),
    "n_symbols": lambda t, w: 5 * F.length(t),
    "n_lines": lambda t, w: 30 * F.length(t),
    "n_dup_lines": lambda t, w: 35 * F.length(t),
    "n_repeat_words": lambda t, w: 2500 * F.size(w),
    "n_shouts": lambda t, w: 5 * F.length(t),
    "n_stutters": lambda t, w: 200 * F.size(w),
}


def with_features(text: Column, body: Callable[[dict[str, Column]], Column], always: Sequence[str] = ()) -> Column:
    """``body`` of the features of a text; its words are split once.

    Features are computed where ``body`` comes to them, but those of ``always``, which are computed once.
    """
    t = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        lazy = {n: f(t, w).cast("long") for n, f in FEATURES.items()}
        if not always:
            return body(lazy)
        return let(F.struct(*[lazy[n].alias(n) for n in always]), lambda s: body({n: s[n] if n in always else c for n, c in lazy.items()}))

    return let(words_of(t), of)


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects`` of the named features holds."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]

    def on(self, features: dict[str, Column]) -> Column:
        return F.coalesce(self.rejects({n: features[n] for n in self.needs}), F.lit(False))

    def on_text(self, text: Column) -> Column:
        return with_features(text, self.on)


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda f: f["n_words"] < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
)
#: The base rules, and more that only take features of the text.
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("shouting", ("n_words", "n_shouts"), lambda f: 10 * f["n_shouts"] > f["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("stuttering", ("n_words", "n_stutters"), lambda f: 10 * f["n_stutters"] > 3 * f["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda f: 2 * f["n_dup_lines"] > f["n_lines"]),
)
SAMPLE_ROWS = 300
SEED = 17


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float  # nanoseconds a row
    rejected: float  # share of rows

    @property
    def rank(self) -> float:
        return self.rejected / self.cost


def measure(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """The rules in the order of rejection per cost on a random sample of at most ``sample_rows`` rows."""
    n = docs.count()  # of a stored table: from its footers
    sample = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, 1.2 * sample_rows / max(n, 1)), seed=SEED).limit(sample_rows)
    t = F.coalesce(F.col("text"), F.lit(""))
    of = lambda w: F.struct(
        *[sum((WORK[k](t, w).cast("long") for k in r.needs), F.lit(0)).alias(f"cost{n}") for n, r in enumerate(rules)],
        *[r.on({k: f(t, w).cast("long") for k, f in FEATURES.items()}).alias(f"hit{n}") for n, r in enumerate(rules)],
    )
    found = sample.select(let(words_of(t), of).alias("x")).agg(
        F.count("*").alias("rows"), *[F.sum(f"x.cost{n}").alias(f"cost{n}") for n in range(len(rules))], *[F.count_if(f"x.hit{n}").alias(f"hit{n}") for n in range(len(rules))]
    ).first()
    rows = max(found["rows"], 1)
    out = [Measured(r, max(found[f"cost{n}"] or 0, rows) / rows, found[f"hit{n}"] / rows) for n, r in enumerate(rules)]
    return sorted(out, key=lambda m: (-m.rank, m.cost))  # stable: of equals, the first listed


def verdict(ordered: Sequence[Rule], features: dict[str, Column]) -> Column:
    """The first rule that rejects, or null; rules after it aren't evaluated."""
    out = None
    for rule in ordered:
        out = F.when(rule.on(features), rule.name) if out is None else out.when(rule.on(features), rule.name)
    return F.lit(None).cast("string") if out is None else out


def quality_filter(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they were."""
    ordered = [m.rule for m in measure(docs, text, rules, sample_rows)]
    return docs.filter(with_features(F.col(text), lambda f: verdict(ordered, f)).isNull())


def quality_features(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, features: Sequence[str] = tuple(FEATURES)
) -> DataFrame:
    """Key, ``features`` and the cascade's verdict (``failed_rule``: null where kept) of every row; other features only where the cascade comes to them."""
    ordered = [m.rule for m in measure(docs, text, rules)]
    both = with_features(F.col(text), lambda f: F.struct(*[f[n].alias(n) for n in features], verdict(ordered, f).alias("failed_rule")), features)
    return docs.select(F.col(key).alias("key"), both.alias("f")).select("key", "f.*")


#: The features that the query returns of every row.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {n: F.col(n) for n in REPORTED}
    base_failed = BASE_RULES[0].on(f) | BASE_RULES[1].on(f)
    return quality_features(table(spark, sf_dir, "documents"), features=REPORTED).select(
        F.col("key").alias("doc_id"), *REPORTED, base_failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept")
    )


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, CAST(sum(least(5, i + 5 - prev_end)) AS BIGINT) AS n
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 5, i) AS prev_end FROM twice)
  GROUP BY doc_id
), f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    CAST(len(regexp_extract_all(t, '!!+')) AS BIGINT) AS n_shouts,
    len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1])) AS n_stutters,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), g AS (
  SELECT *, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_shouts > n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_stutters > 3 * n_words
    OR 2 * n_dup_lines > n_lines) AS kept
FROM g
"""
