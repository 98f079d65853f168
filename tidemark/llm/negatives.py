"""Hard-negative mining: joins of anchors with all rows above thresholds that fall until every window is full.

Vectors are whole numbers.  Rows and anchors are dealt into blocks of a bounded size, and each block of anchors meets each
block of rows in a task of its own (``cogroup``), so that nothing is broadcast and no key is hot.  In a task the rows are an
inverted index over dimensions, the heaviest first: a row's posting ends where the norm of what follows, times any anchor's,
can't reach a threshold any more.  Partial scores grow chunk by chunk of dimensions, and a pair goes as soon as its partial
score and the norms of what remains can't reach the anchor's threshold.  A task gives the best few for each window, never
all that pass.

Positives come first, from thresholds that begin near the greatest score an anchor can have; then negatives in the windows that the positives span, from
thresholds near the weakest positive down to the lower end of its window.  Only anchors whose windows aren't full go on.

Rows whose label or vector is null, or holds null or components that aren't finite, take no part, nor do rows without an
id.  Rows that repeat count each for themselves; shorter vectors are as if filled with zeros; scores stop at the ends of a
long.  Columns other than id, label and vector don't matter.  No rows, no anchors: no result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Positives an anchor, negatives a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Numbers in a block of rows, and anchors in a block.
BLOCK_CELLS, BLOCK_ANCHORS = 1 << 19, 512
#: Dimensions that are added up between two looks at what can still be reached.
CHUNK = 16
#: Thresholds of positives: of the greatest score that an anchor can have, falling by this factor, and from where on zero.
FIRST, FALL, LEAST = 0.75, 0.7, 0.04
LONG = (1 << 63) - 1


def _rest(x: np.ndarray) -> np.ndarray:
    """Norms of what each row has from each dimension on; one column more than dimensions."""
    out = np.zeros((x.shape[0], x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(np.square(x)[:, ::-1], axis=1)[:, ::-1])
    return out


def pairs_above(x: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs of ``q`` and ``x`` whose inner product is ``least`` (one an anchor) or more."""
    n, d = x.shape
    if math.sqrt(float(np.square(x).sum(1).max(initial=0))) * math.sqrt(float(np.square(q).sum(1).max(initial=0))) >= 2.0**52:
        s = np.array([[sum(a * b for a, b in zip(u, v, strict=True)) for v in _whole(x)] for u in _whole(q)], dtype=object).reshape(len(q), n)
        i, j = np.nonzero(s >= least[:, None])
        return i, j, np.array([max(-LONG - 1, min(LONG, v)) for v in s[i, j]], dtype=np.int64)
    heaviest = np.argsort(-np.square(x).sum(0), kind="stable")
    x, q = x[:, heaviest], q[:, heaviest]
    rest_x, rest_q = _rest(x), _rest(q)
    with np.errstate(divide="ignore", invalid="ignore"):
        matters = np.where(least[:, None] <= 0, 0, least[:, None] / rest_q).min(0, initial=np.inf)
    posted = rest_x * (1 + 1e-9) >= matters
    posted[:, -1] = False
    ends = np.minimum(-(-posted.sum(1) // CHUNK) * CHUNK, d)
    if (least <= 0).any():
        ends[:] = d
    order = np.argsort(-ends, kind="stable")
    x, rest_x, ends = x[order], rest_x[order], ends[order]
    found: list[tuple] = []
    live = int((ends > 0).sum())
    s = np.zeros((len(q), live))
    for at in range(0, d, CHUNK):
        to = min(at + CHUNK, d)
        if not live:
            break
        s[:, :live] += q[:, at:to] @ x[:live, at:to].T
        more = int((ends > to).sum())
        reach = s[:, :live] + rest_q[:, to, None] * rest_x[None, :live, to] * (1 + 1e-9) + 0.25 >= least[:, None]
        few = reach[:, :more].sum() * 8 <= len(q) * max(more, 1)
        first = 0 if few else more
        i, j = np.nonzero(reach[:, first:])
        found.append(_finished(x, q, rest_x, rest_q, least, i, j + first, s[i, j + first], to))
        live = first
    i, j, v = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return i, order[j], v.astype(np.int64)


def _whole(x: np.ndarray) -> list[list[int]]:
    return [[int(v) for v in row] for row in x]


def _finished(x, q, rest_x, rest_q, least, i, j, s, at) -> tuple:
    """The pairs that reach their threshold once the dimensions from ``at`` on are added."""
    while at < x.shape[1] and len(i):
        to = min(at + CHUNK, x.shape[1])
        s = s + np.einsum("ij,ij->i", q[i, at:to], x[j, at:to])
        keep = s + rest_q[i, to] * rest_x[j, to] * (1 + 1e-9) + 0.25 >= least[i]
        i, j, s, at = i[keep], j[keep], s[keep], to
    keep = s >= least[i]
    return i[keep], j[keep], s[keep]


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    lists = column.combine_chunks()
    out = np.zeros((len(lists), d))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(d) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` of each anchor, the highest scores first, ties by id."""
    order = np.lexsort((ids[j], -s, i))
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < n]


_HITS = "anchor long, row long, id long, score long"


def _hits(rows: DataFrame, anchors: DataFrame, shape: tuple[int, int, int], same: bool, n: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Per anchor (row, label, vec, least, windows) and block, the best ``n`` rows of the same label, or of another label in each of ``windows``."""
    d, parts, blocks = shape
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    right = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "row", "id", "score")])

    def meet(r: pa.Table, a: pa.Table) -> pa.Table:
        if not len(r) or not len(a):
            return schema.empty_table()
        ids, own, labels = (r[c].to_numpy() for c in ("id", "row", "label"))
        a_row, a_label, least = (a[c].to_numpy() for c in ("row", "label", "least"))
        i, j, s = pairs_above(_matrix(r["vec"], d), _matrix(a["vec"], d), least)
        fits = (own[j] != a_row[i]) & ((labels[j] == a_label[i]) == same)
        i, j, s = i[fits], j[fits], s[fits]
        if same:
            kept = _best(i, j, s, ids, n)
        else:
            tops, picked = a["windows"].to_pylist(), [np.zeros(0, int)]
            for k in range(max(map(len, tops), default=0)):
                top = np.array([w[k] if k < len(w) else -1 for w in tops], dtype=np.int64)[i]
                inside = np.flatnonzero((s <= top) if high == 100 else (100 * s <= high * top))
                inside = inside[100 * s[inside] >= low * top[inside]]
                picked.append(inside[_best(i[inside], j[inside], s[inside], ids, n)])
            kept = np.unique(np.concatenate(picked))
        return pa.table([a_row[i[kept]], own[j[kept]], ids[j[kept]], s[kept]], schema=schema)

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, _HITS)


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def _union(frames: list[DataFrame], spark: SparkSession, ddl: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else _empty(spark, ddl)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block_cells: int = BLOCK_CELLS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``vectors`` (id long, label long, vec array<long>): (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the ``positives`` other rows of its label with the highest inner product, each positive's negatives
    the first ``negatives`` of other labels whose score is ``low`` to ``high`` hundredths of the positive's; 0 < low <= high <= 100.
    Scores below zero have no such window.  Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vec", is_anchor.alias("anchor"))
    rows = written(whole.dropna(subset=["id", "label", "vec"]).withColumn("row", F.monotonically_increasing_id()))
    n, d, asked = rows.agg(F.count("*"), F.max(F.size("vec")), F.count_if("anchor")).first()
    ddl = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked:
        return _empty(spark, ddl)
    d = max(d, 1)
    # no more tasks than rows ask for, and blocks of anchors in the same way
    shape = (d, -(-n // max(1, block_cells // d)), -(-asked // block_anchors))
    squares = F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    longest = math.sqrt(rows.agg(F.max(squares)).first()[0])
    sizes = rows.groupBy("label").agg((F.count("*") - 1).alias("others"))
    anchors = rows.filter("anchor").join(sizes, "label").select(
        "row", "id", "label", "vec", F.least("others", F.lit(positives)).alias("wanted"), (F.sqrt(squares) * longest).alias("greatest")
    )
    data = rows.select("row", "id", "label", "vec")

    todo, share, first = written(anchors.filter("wanted > 0")), FIRST, []
    while not todo.isEmpty():
        least = F.col("greatest") * share if share >= LEAST else F.lit(0.0)
        hits = written(_hits(data, todo.select("row", "label", "vec", least.alias("least")), shape, True, positives))
        ranked = hits.withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row"))).filter(F.col("k") <= positives)
        lists = ranked.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score", "row"))).alias("found"))
        both = written(todo.join(lists, F.col("row") == F.col("anchor"), "left").drop("anchor"))
        full = F.coalesce(F.size("found") >= F.col("wanted"), F.lit(False)) if share >= LEAST else F.lit(True)
        first.append(both.filter(full & F.col("found").isNotNull()))
        todo, share = written(both.filter(~full).drop("found")), share * FALL

    each = "array<struct<k:int,id:bigint,score:bigint,row:bigint>>"
    judged = _union(first, spark, f"row long, id long, label long, vec array<long>, wanted long, greatest double, found {each}")
    judged = written(judged.select("row", "id", "label", "vec", F.filter("found", lambda p: p["score"] >= 0).alias("found")).filter(F.size("found") > 0))
    weakest = F.array_min(F.transform("found", lambda p: p["score"]))
    ends = (weakest * ((low + high) / 200), F.ceil(weakest * low / 100).cast("double"))  # half of the weakest window, then all of it
    todo, out = judged, []
    for last, least in enumerate(ends):
        if todo.isEmpty():
            break
        tops = F.array_distinct(F.transform("found", lambda p: p["score"]))
        hits = written(_hits(data, todo.select("row", "label", "vec", least.alias("least"), tops.alias("windows")), shape, False, negatives, low, high))
        wanted = todo.select("row", F.col("id").alias("anchor_id"), least.alias("least"), F.explode("found").alias("p"))
        inside = (100 * F.col("score") >= low * F.col("p.score")) & (100 * F.col("score") <= high * F.col("p.score"))
        met = wanted.join(hits.withColumnsRenamed({"row": "negative", "id": "negative_id"}), F.col("row") == F.col("anchor")).filter(inside)
        order = Window.partitionBy("row", "p.k").orderBy(F.col("score").desc(), "negative_id", "negative")
        ranked = written(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
            "row", "anchor_id", F.col("p.k").alias("k"), F.col("p.id").alias("positive_id"), "rank", "negative_id",
            F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
        ))
        if last == 0:
            counts = ranked.groupBy("row", "k").count()
            open_ = wanted.select("row", "least", F.col("p.k").alias("k"), F.col("p.score").alias("score")).join(counts, ["row", "k"], "left")
            open_ = open_.filter((F.coalesce("count", F.lit(0)) < negatives) & (100 * F.col("least") > low * F.col("score"))).select("row").distinct()
            todo = written(todo.join(open_, "row", "left_semi"))
            ranked = ranked.join(todo.select("row"), "row", "left_anti")
        out.append(ranked)
    return _union(out, spark, f"row long, k int, {ddl}").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def scaled(vec: Column) -> Column:
    """Whole-number vectors: floor(256 * x) of each component; null where one is null or not finite."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * 256)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by the contract's labels, scores and windows."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), scaled(F.col("embedding")).alias("vec"))
    return mine(rows, F.coalesce(F.col("id") % 100 == 0, F.lit(False)))


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS anchor_id, r.id AS other, a.label = r.label AS same, list_inner_product(a.vec, r.vec)::BIGINT AS score
  FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
), windows AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= {NEGATIVES}
"""
