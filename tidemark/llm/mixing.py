"""Operator 7: mixing sources to target weights by Pareto order sampling.

Sources get shares of all words by weight, at most ``cap`` times their own words, the excess going
to the others by weight.  A source's documents are first taken whole ``floor(target / size)`` times.
The rest of the target is drawn without replacement with inclusion probabilities in proportion to
size (1 where that would exceed 1): documents are ranked by the odds of a uniform number over their
inclusion odds, and the ranking is cut where the words drawn come nearest to the rest.  The uniform
number is a digest of seed, id, text and the row's number among its equals, so that every row draws
its own, and reruns and lost executors give the same mix.

Defined results: a null text has size 0; the null source is a source of its own, last; rows that repeat an
id and a text draw numbers of their own, so that as many of them are taken as the target wants, whichever
they are; a null id is an id; equal ranks go by digest; very long texts are documents like any and can leave
a source's mix off its target by half their size; columns of ``docs`` don't matter; an empty table gives an
empty table.  Windows run over ranges of sources, over the distinct sizes of a source, over the documents of
the one rank bin in which its cut falls, and over a task's rows of one repeated document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import all_columns, running, table, word_count, written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: Documents of a source that a rank bin should hold.
BIN_ROWS = 10_000
#: Bytes up to which the table of sources is broadcast, and bytes of its row beside the name.
BROADCAST_BYTES, SOURCE_BYTES = 8 << 20, 160


def digest(key: Column, text_md5: Column, nth: Column, seed: str = SEED) -> Column:
    """What a row's place in the ranking depends on: seed, id, the text's digest and the row's number among its equals."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), text_md5, nth.cast("string")).cast("binary"))


def uniform(digest_: Column) -> Column:
    """A number in [0, 1) of 52 bits."""
    return F.conv(F.substring(digest_, 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, text_md5), written, with nth: 0, 1, ... among equal rows.

    Only rows that have equals are looked at: each task's rows of a group are numbered by themselves and set off by
    the tasks before, so that a group of any size is split as the table is.
    """
    same = ["doc_id", "source", "text_md5"]
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    drawn = rows.filter("size > 0").select(*same, "_row", F.shiftright("_row", 33).alias("_task"))
    counts = drawn.groupBy(*same, "_task").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*same)  # a row for each task that has such rows
    before = group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    repeated = written(
        counts.withColumns({"_all": F.sum("_n").over(group), "_before": F.coalesce(F.sum("_n").over(before), F.lit(0))}).filter("_all > 1").select(*same, "_task", "_before")
    )
    if not repeated.head(1):
        return rows.withColumn("nth", F.lit(0).cast("long")).drop("_row")
    l, r = drawn.alias("l"), repeated.alias("r")  # noqa: E741
    equal = (F.col("l._task") == F.col("r._task")) & reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in same])
    inside = Window.partitionBy(*[F.col(f"l.{c}") for c in same], F.col("l._task")).orderBy("_row")
    places = l.join(r, equal).select(F.col("_row").alias("_at"), (F.col("_before") + F.row_number().over(inside) - 1).alias("nth"))
    return written(rows.join(places, F.col("_row") == F.col("_at"), "left").withColumn("nth", F.coalesce("nth", F.lit(0)).cast("long")).drop("_row", "_at"))


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: source_size, n_docs, target, whole (copies of every document), rest (words still to draw)."""
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    per = running(per, [F.col("source").asc_nulls_last()], {"k": F.lit(1).cast("long")})
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int")).cast("long")
    # a source is held at its cap if, the fuller ones being so, its share of what is left would pass it
    per = per.withColumn("w", w).withColumn("fullness", cap * F.col("source_size") / F.col("w"))
    per = running(per, [F.col("fullness").asc(), F.col("source").asc_nulls_last()], {"capped_to": cap * F.col("source_size"), "w_to": F.col("w")})
    all_size, all_w = per.agg(F.sum("source_size"), F.sum("w")).first()
    per = per.withColumns(
        {
            "left": F.lit(all_size or 0) - (F.col("capped_to") - cap * F.col("source_size")),
            "w_left": F.lit(all_w or 0) - (F.col("w_to") - F.col("w")),
        }
    ).withColumn("capped", cap * F.col("source_size") * F.col("w_left") <= F.col("w") * F.col("left"))
    per = written(per)
    open_ = per.filter(~F.col("capped")).agg(F.max(F.struct("w_left", "left")).alias("open")).first()["open"]
    target = (cap * F.col("source_size")).cast("double")
    if open_:
        target = F.when(F.col("capped"), target).otherwise((F.col("w") * F.lit(open_["left"])) / F.lit(open_["w_left"]))
    per = per.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return per.withColumn("whole", whole.cast("long")).select(
        "source", "source_size", "n_docs", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")
    )


def inclusion_scale(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: ``scale``, for which the sum of min(1, scale * size) * size is the rest to draw."""
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    counts = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    larger = Window.partitionBy("source").orderBy(F.col("size").desc())
    words = (F.col("n") * F.col("size")).cast("decimal(38,0)")
    squares = words * F.col("size").cast("decimal(10,0)")
    cum = (
        counts.withColumn("words_to", F.sum(words).over(larger).cast("double") - words.cast("double"))
        .withColumn("all_squares", F.sum(squares.cast("decimal(38,0)")).over(Window.partitionBy("source")))
        .withColumn("squares_from", (F.col("all_squares") - F.sum(squares.cast("decimal(38,0)")).over(larger) + squares).cast("double"))
    )
    steps = cum.alias("s").join(sources.alias("t"), same).select(
        F.col("t.source").alias("source"),
        F.col("s.size").alias("size"),
        ((F.col("t.rest") - F.col("s.words_to")) / F.col("s.squares_from")).alias("scale"),
    )
    # the first size that isn't certain has the scale of all that aren't
    open_ = F.col("scale") * F.col("size") < 1
    return steps.filter(open_).groupBy("source").agg(F.max_by("scale", "size").alias("scale"))


def rank_value(size: Column, scale: Column, u: Column) -> Column:
    """Odds of u over inclusion odds, mapped to [0, 1] in the same order; certain documents have 0."""
    p = F.least(F.lit(1.0), scale * size)
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when((size <= 0) | (p <= 0), F.lit(1.0)).when(p >= 1, F.lit(0.0)).otherwise(q / (1 + q))


def _with_source(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Inner join by source, null with null; ``sources`` has one row each and is broadcast if it was found to be small."""
    right = sources.withColumnRenamed("source", "_mix_source")
    right = F.broadcast(right) if small else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")


def mix_plan(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (doc_id, source, size, digest, a name for the row's draw; a written table) with source_size, target, taken and copies."""
    sources = written(source_targets(sizes, cap, weights))
    n_sources, most, name_bytes = sources.agg(F.count("*"), F.max("n_docs"), F.max(F.octet_length(F.col("source").cast("string")))).first()
    if not n_sources:
        none = F.lit(0).cast("long")
        return sizes.select("*", none.alias("source_size"), F.lit(0.0).alias("target"), none.alias("taken"), none.alias("copies"))
    small = n_sources * (SOURCE_BYTES + (name_bytes or 0)) <= BROADCAST_BYTES
    bins = 1 << max(8, min(20, (most // BIN_ROWS).bit_length()))
    scales = inclusion_scale(sizes, sources).withColumnRenamed("source", "_scale_source")
    sources = written(
        sources.join(scales, F.col("source").eqNullSafe(F.col("_scale_source")), "left").drop("_scale_source").fillna(0.0, ["scale"])
    )

    def ranked(rows: DataFrame) -> DataFrame:
        # certain documents have a bin of their own, -1, in which no cut falls
        return rows.withColumn("rank", rank_value(F.col("size"), F.col("scale"), uniform(F.col("digest")))).withColumn(
            "bin", F.when(F.col("rank") > 0, F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1))).otherwise(-1).cast("long")
        )

    drawn = ranked(_with_source(sizes, sources, small)).filter("rest > 0 and size > 0")
    by_bin = drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    cut_bin = (
        by_bin.withColumn("upto", upto)
        .filter((F.col("upto") >= F.col("rest")) & (F.col("bin") >= 0))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    )
    sources = written(
        sources.join(cut_bin.withColumnRenamed("source", "_cut_source"), F.col("source").eqNullSafe(F.col("_cut_source")), "left")
        .drop("_cut_source")
        .select("*", F.coalesce("cut.bin", F.lit(bins)).alias("cut_bin"), F.coalesce("cut.before", F.lit(0)).alias("cut_before"))
        .drop("cut")
    )
    # inside the bin of the cut, documents are ranked one by one
    inside = ranked(_with_source(sizes, sources, small)).filter("rest > 0 and size > 0 and bin = cut_bin")
    order = Window.partitionBy("source").orderBy("rank", "digest").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        inside.withColumn("upto", F.col("cut_before") + F.sum("size").over(order))
        .filter(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("rank", "digest")).alias("last"))
    )
    sources = written(
        sources.join(last.withColumnRenamed("source", "_last_source"), F.col("source").eqNullSafe(F.col("_last_source")), "left").drop("_last_source")
    )
    taken_once = (F.col("rest") > 0) & (F.col("size") > 0) & (
        (F.col("bin") < F.col("cut_bin"))
        | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(F.struct("rank", "digest") <= F.col("last"), F.lit(False)))
    )
    copies = F.col("whole") + F.when(taken_once, 1).otherwise(0)
    return ranked(_with_source(sizes, sources, small)).select(
        *sizes.columns, "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies")
    )


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) and copies of every row of ``docs``."""
    return _mixed(docs, [], key, text, source, seed, **how)


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns as they were, and ``copies``, how often; a column of that name gives way.

    Texts are written once, beside what the draw needs, and not shuffled: what is known of the sources comes to them.
    """
    whole = F.struct(*all_columns(docs)).alias("_doc")
    mixed = _mixed(docs, [whole], key, text, source, seed, **how).filter("copies > 0")
    return mixed.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns if c != "copies"], "copies")


def _mixed(docs: DataFrame, carried: list[Column], key: str, text: str, source: str, seed: str, **how) -> DataFrame:
    t = F.col(text)
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(t).alias("size"), F.md5(F.coalesce(t, F.lit("")).cast("binary")).alias("text_md5"), *carried
    )
    named = numbered(rows).withColumn("digest", digest(F.col("doc_id"), F.col("text_md5"), F.col("nth"), seed))
    sized = named.drop("text_md5", "nth")
    # numbered rows are a written table already; without texts a smaller one is worth it
    return mix_plan(sized if carried else written(sized), **how).drop("digest")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)) AS digest,
    CAST(('0x' || substr(digest, 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS words_left, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
  FROM s WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, 3 * source_size * w_left <= w * words_left AS capped FROM o
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST(w * (SELECT arg_max(words_left, w_left) FROM c WHERE NOT capped) AS DOUBLE) / (SELECT max(w_left) FROM c WHERE NOT capped) END AS target
  FROM c
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM t
), n AS (
  SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size
), cum AS (
  SELECT *, sum(n * size) OVER l - n * size AS words_to,
    sum(n * size * size) OVER (PARTITION BY source) - sum(n * size * size) OVER l + n * size * size AS squares_from
  FROM n WINDOW l AS (PARTITION BY source ORDER BY size DESC)
), k AS (
  SELECT cum.source, arg_max((rest - CAST(words_to AS DOUBLE)) / CAST(squares_from AS DOUBLE), size) AS scale
  FROM cum JOIN r ON cum.source IS NOT DISTINCT FROM r.source
  WHERE (rest - CAST(words_to AS DOUBLE)) / CAST(squares_from AS DOUBLE) * size < 1 GROUP BY cum.source
), p AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.rest, least(1.0, coalesce(scale, 0) * size) AS p
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
), q AS (
  SELECT *, CASE WHEN size <= 0 OR p <= 0 THEN 1.0 WHEN p >= 1 THEN 0.0
    ELSE ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS rank FROM p
), a AS (
  SELECT *, sum(CASE WHEN size > 0 THEN size END) OVER (PARTITION BY source ORDER BY rank, digest ROWS UNBOUNDED PRECEDING) AS upto FROM q
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND size > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM a
"""
