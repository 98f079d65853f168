"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, and greedy search over it.

Equal vectors are one node.  A node's vector gets one component more, so that all are equally long and the nearest by angle
are the nearest by inner product for a longest vector; the graph is built on these, as bytes with a scale.

* **Start**: random hyperplanes deal the nodes into leaves some times over; leaves too large are split at random, so that no
  group of near copies meets in one task; nodes of a leaf are compared.
* **NN-descent**: each round joins every node's neighbours, and some that it is a neighbour of, with their vectors,
  compares the neighbours with each other where one of the two is new, and keeps each node's best.  It ends once few change.
* **Search**: a query keeps its best ``beam`` nodes.  In a round it visits the best of those it hasn't yet: queries meet a node's
  neighbours, which its row carries as bytes, and take in what is better than the worst they keep.  It ends when every query has visited all it keeps.
* **Result**: scores of the kept nodes from the original vectors in double precision, then copies back in their place.

Everything is keyed by node or query, so work per query doesn't grow with the table but for its logarithm, and tables of each
round are written, which ends lineage.  Vectors that are null, zero, or hold null or components that aren't finite take no part, nor do
rows without an id.  Repeated ids are rows of their own; a shorter vector is as if filled with zeros.  Columns other than id and
vector don't matter.  No rows, or no queries: no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Neighbours a node, dealings into leaves of about so many, rounds at most, share of new neighbours at which descent ends, nodes that a query keeps.
DEGREE, DEALS, LEAF, ROUNDS, SETTLED, BEAM = 40, 4, 200, 8, 0.08, 160
#: Nodes of the longest vectors at which each query begins too, and results a query.
LONGEST, NEAREST = 8, 20
#: Nodes that a query visits in a round, queries at one node in a task, and rows that a task has at once, asking ones and others.
STEP, CROWD, ASKED, TOGETHER = 48, 4096, 512, 4096

_LIST = "node long, nbrs array<long>, sims array<float>, old boolean"
_LIST_SCHEMA = pa.schema([("node", pa.int64()), ("nbrs", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("old", pa.bool_())])


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows come ordered by their first ``keys`` columns, and a group isn't cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        changes = np.zeros(len(b), bool)
        for k in range(keys):
            own = b.column(k).to_numpy(zero_copy_only=False)
            changes[1:] |= own[1:] != own[:-1]
            changes[0] |= bool(held) and held[-1].column(k)[len(held[-1]) - 1].as_py() != own[0]
        cut = np.flatnonzero(changes)
        if len(cut) and sum(map(len, held)) + cut[-1] >= TOGETHER:
            yield pa.Table.from_batches([*held, b.slice(0, cut[-1])])
            held = [b.slice(cut[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if n > 1 else False
    return np.append(np.flatnonzero(new), n)


def _vectors(code: pa.ChunkedArray, scale: np.ndarray) -> np.ndarray:
    """Vectors from bytes and scales."""
    joined = b"".join(code.to_pylist())
    return np.frombuffer(joined, np.int8).reshape(len(scale), -1).astype(np.float32) * scale[:, None]


def _pairs(batches: Iterator[pa.RecordBatch], keys: int, degree: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, node, new, least, code, scale) in order of keys: per key and node the best of the key's other nodes, above the node's ``least``, one of the two being new."""
    for t in _groups(batches, keys):
        group = _starts(*[t.column(k).to_numpy() for k in range(keys)])
        node, new, least, scale = (t[c].to_numpy() for c in ("node", "new", "least", "scale"))
        vec = _vectors(t["code"], scale)
        sizes = np.diff(group)
        # groups of about one size together, filled up to that of the largest
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            most = max(1, TOGETHER * 16 // max(1, int(sizes[order[min(at + 63, len(order) - 1)]])) ** 2)
            some = order[at : at + min(most, 64)]
            at += len(some)
            width = int(sizes[some].max())
            if width < 2:
                continue
            spot = group[some][:, None] + np.arange(width)
            real = np.arange(width) < sizes[some][:, None]
            spot = np.where(real, spot, 0)
            sim = np.matmul(vec[spot], vec[spot].transpose(0, 2, 1))
            fits = real[:, :, None] & real[:, None, :] & (new[spot][:, :, None] | new[spot][:, None, :]) & (sim > least[spot][:, :, None])
            fits[:, np.arange(width), np.arange(width)] = False
            fits &= node[spot][:, :, None] != node[spot][:, None, :]
            if width > degree:  # no more than ``degree`` of a group can stay in a node's list
                sim = np.where(fits, sim, -np.inf)
                bar = -np.partition(-sim, degree - 1, axis=2)[:, :, degree - 1]
                fits &= sim >= bar[:, :, None]
            g, i, j = np.nonzero(fits)
            if not len(g):
                continue
            owner = spot[g, i]
            cut = _starts(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[owner[cut[:-1]]]), _lists(node[spot[g, j]], np.diff(cut), pa.int64()), _lists(sim[g, i, j], np.diff(cut), pa.float32()), pa.array(np.zeros(len(cut) - 1, bool))],
                schema=_LIST_SCHEMA,
            )


def _merged(batches: Iterator[pa.RecordBatch], degree: int) -> Iterator[pa.RecordBatch]:
    """Lists in order of nodes: each node's best ``degree``, and which of them are in no old list."""
    schema = pa.schema([("node", pa.int64()), ("nbrs", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("news", pa.list_(pa.bool_()))])
    for t in _groups(batches, 1):
        t = t.combine_chunks()
        lists = t["nbrs"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        node, new = np.repeat(t["node"].to_numpy(), sizes), ~np.repeat(t["old"].to_numpy(zero_copy_only=False), sizes)
        nbr, sim = lists.flatten().to_numpy(), t["sims"].combine_chunks().flatten().to_numpy()
        if not len(node):
            continue
        order = np.lexsort((new, nbr, node))
        order = order[_starts(node[order], nbr[order])[:-1]]
        order = order[np.lexsort((nbr[order], -sim[order], node[order]))]
        owner = node[order]
        order = order[np.arange(len(owner)) - np.searchsorted(owner, owner) < degree]
        node = node[order]
        cut = _starts(node)
        n = np.diff(cut)
        yield pa.RecordBatch.from_arrays([pa.array(node[cut[:-1]]), _lists(nbr[order], n, pa.int64()), _lists(sim[order], n, pa.float32()), _lists(new[order], n, pa.bool_())], schema=schema)


def _keyed(df: DataFrame, keys: list[str], run: Callable, ddl: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def _merge(lists: DataFrame, degree: int) -> DataFrame:
    return _keyed(lists.select("node", "nbrs", "sims", "old"), ["node"], lambda b: _merged(b, degree), "node long, nbrs array<long>, sims array<float>, news array<boolean>")


def _coded(nodes: DataFrame, d: int, longest: float) -> DataFrame:
    """(node, code, scale): vectors of length one, with the component that makes up for their length, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _dense(b.column(1), d) / longest
            x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - np.square(x).sum(1)))[:, None]], axis=1)
            scale = np.abs(x).max(1, initial=0) / 127
            code = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale.astype(np.float32))], names=["node", "code", "scale"])

    return nodes.select("node", "vec").mapInArrow(run, "node long, code binary, scale float")


def _asked(nodes: DataFrame, d: int, longest: float) -> DataFrame:
    """(query, asked): bytes of single-precision vectors to multiply with coded ones; what makes up for lengths doesn't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([_dense(b.column(1), d) / longest, np.zeros((len(b), 1))], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["query", "asked"])

    return nodes.select("node", "vec").mapInArrow(run, "query long, asked binary")


def _dense(lists: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), d))
    out[np.arange(d) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _dealt(coded: DataFrame, d: int, n: int, deals: int, leaf: int) -> DataFrame:
    """(deal, leaf, part, node, code, scale): leaves between random hyperplanes, in parts of about ``leaf`` rows."""
    planes = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    signs = np.random.default_rng(7).standard_normal((d + 1, deals, min(planes, 60)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(pa.chunked_array([b.column(1)]), b.column(2).to_numpy())
            for deal in range(deals):
                own = (x @ signs[:, deal] > 0) @ (1 << np.arange(signs.shape[2])) if signs.shape[2] else np.zeros(len(b), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), deal, np.int32)), pa.array(own.astype(np.int64)), *b.columns], names=["deal", "leaf", "node", "code", "scale"])

    rows = written(coded.mapInArrow(run, "deal int, leaf long, node long, code binary, scale float"))
    sizes = rows.groupBy("deal", "leaf").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / (2 * leaf))
    return rows.join(sizes, ["deal", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "deal"), parts))


def _both_ways(graph: DataFrame, degree: int) -> DataFrame:
    """(node, nbr, new): neighbours, and of the nodes that a node is a neighbour of ``degree``, new ones first."""
    own = graph.select("node", F.explode(F.arrays_zip("nbrs", "news")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.news").alias("new"))
    order = Window.partitionBy("nbr").orderBy(F.col("new").desc(), F.xxhash64("node", "nbr"))
    back = own.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= degree).select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "new")
    return own.union(back).groupBy("node", "nbr").agg(F.bool_or("new").alias("new"))


def neighbour_graph(coded: DataFrame, d: int, n: int, degree: int = DEGREE, deals: int = DEALS, leaf: int = LEAF, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(node, nbrs, sims, news): about the ``degree`` nearest of each of the ``n`` nodes of ``coded`` (node, code, scale)."""
    rows = _dealt(coded, d, n, deals, leaf).select("deal", "leaf", "part", "node", F.lit(True).alias("new"), F.lit(float("-inf")).cast("float").alias("least"), "code", "scale")
    start = _keyed(rows, ["deal", "leaf", "part"], lambda b: _pairs(b, 3, degree), _LIST)
    graph = written(_merge(start, degree))
    for _ in range(rounds):
        fresh, all_ = graph.agg(F.sum(F.size(F.filter("news", lambda x: x))), F.sum(F.size("nbrs"))).first()
        if not all_ or fresh <= settled * all_:
            break
        least = graph.select(F.col("node").alias("nbr"), F.when(F.size("sims") >= degree, F.array_min("sims")).otherwise(float("-inf")).cast("float").alias("least"))
        known = coded.withColumnRenamed("node", "nbr").join(least, "nbr", "left").fillna(float("-inf"), ["least"])
        near = _both_ways(graph, degree).join(known, "nbr").select(F.col("node").alias("key"), F.col("nbr").alias("node"), "new", "least", "code", "scale")
        better = _keyed(near, ["key"], lambda b: _pairs(b, 1, degree), _LIST)
        graph = written(_merge(graph.select("node", "nbrs", "sims", F.lit(True).alias("old")).union(better), degree))
    return graph


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, code, scale) in order of keys: per key its nodes and their bytes, one after the other."""
    for t in _groups(batches, 1):
        cut = _starts(t["key"].to_numpy())
        code = t["code"].to_pylist()
        n = np.diff(cut)
        yield pa.RecordBatch.from_arrays(
            [pa.array(t["key"].to_numpy()[cut[:-1]]), _lists(t["node"].to_numpy(), n, pa.int64()), pa.array([b"".join(code[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), _lists(t["scale"].to_numpy(), n, pa.float32())],
            names=["node", "ids", "codes", "scales"],
        )


def _links(graph: DataFrame, coded: DataFrame, degree: int) -> DataFrame:
    """(node, ids, codes, scales): neighbours both ways with their bytes, one after the other."""
    near = _both_ways(graph, degree).join(coded.withColumnRenamed("node", "nbr"), "nbr").select(F.col("node").alias("key"), F.col("nbr").alias("node"), "code", "scale")
    return _keyed(near, ["key"], _linked, "node long, ids array<long>, codes binary, scales array<float>")


def _better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, part, query, least, asked, ids, codes, scales) in order of node and part, of each first its links and then who asks for them: the
    linked nodes whose product with what is asked is above ``least``."""
    for t in _groups(batches, 2):
        query = t["query"].combine_chunks()
        asks = np.flatnonzero(query.is_valid().to_numpy(zero_copy_only=False))
        links = np.flatnonzero(~query.is_valid().to_numpy(zero_copy_only=False))
        own = t.take(links)
        lists = own["ids"].combine_chunks()
        ids, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        scale = own["scales"].combine_chunks().flatten().to_numpy()
        code = np.frombuffer(b"".join(own["codes"].to_pylist()), np.int8).reshape(len(ids), -1)
        begins = np.cumsum(sizes) - sizes
        of = np.searchsorted(links, asks) - 1  # the links that an asking row follows
        some = t.take(asks)
        asked = np.frombuffer(b"".join(some["asked"].to_pylist()), np.float32).reshape(len(asks), -1)
        query, least = some["query"].to_numpy(), some["least"].to_numpy()
        for at in range(0, len(asks), ASKED):
            to = min(at + ASKED, len(asks))
            n = sizes[of[at:to]]
            row = np.repeat(np.arange(at, to), n)
            link = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[of[at:to]], n)
            score = np.einsum("ij,ij->i", code[link].astype(np.float32), asked[row]) * scale[link]
            keep = score > least[row]
            yield pa.RecordBatch.from_arrays([pa.array(query[row[keep]]), pa.array(ids[link[keep]]), pa.array(score[keep])], names=["query", "node", "score"])


def greedy_search(queries: DataFrame, begin: DataFrame, links: DataFrame, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """``queries`` (query, asked), ``begin`` (query, node): (query, node), the about ``beam`` best nodes of each query."""
    kept = written(begin.select("query", "node", F.lit(float("-inf")).cast("float").alias("score"), F.lit(False).alias("done")).distinct())
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    while True:
        ahead = kept.filter("not done").withColumn("k", F.row_number().over(best)).filter(F.col("k") <= step).select("query", "node")
        if ahead.isEmpty():
            return kept.select("query", "node")
        worst = kept.groupBy("query").agg(F.when(F.count("*") >= beam, F.min("score")).otherwise(float("-inf")).cast("float").alias("least"))
        # links go to where they are asked for; what very many ask for is dealt out with the askers
        crowd = ahead.groupBy("node").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
        none = lambda kind: F.lit(None).cast(kind)
        asks = ahead.join(crowd, "node").join(worst.join(queries, "query"), "query").select(
            "node", F.pmod(F.xxhash64("query"), "parts").cast("int").alias("part"), "query", "least", "asked", none("array<bigint>").alias("ids"), none("binary").alias("codes"), none("array<float>").alias("scales")
        )
        asked = links.join(crowd, "node").select(
            "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none("bigint").alias("query"), none("float").alias("least"), none("binary").alias("asked"), "ids", "codes", "scales"
        )
        met = asked.union(asks).repartition("node", "part").sortWithinPartitions("node", "part", F.col("query").asc_nulls_first())
        found = met.mapInArrow(_better, "query long, node long, score float")
        both = kept.join(ahead.withColumn("now", F.lit(True)), ["query", "node"], "left").select("query", "node", "score", (F.col("done") | F.col("now").isNotNull()).alias("done"))
        each = both.union(found.select("query", "node", "score", F.lit(False))).groupBy("query", "node").agg(F.max("score").alias("score"), F.bool_or("done").alias("done"))
        kept = written(each.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= beam).drop("k"))


def _exact(pairs: DataFrame, d: int) -> DataFrame:
    """``pairs`` (query, node, x, y) with score, the inner product in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), TOGETHER):
                b = whole.slice(at, TOGETHER)
                score = np.einsum("ij,ij->i", _dense(b.column(2), d), _dense(b.column(3), d))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["query", "node", "score"])

    return pairs.select("query", "node", "x", "y").mapInArrow(run, "query long, node long, score double")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEAREST, degree: int = DEGREE, beam: int = BEAM, deals: int = DEALS, leaf: int = LEAF, rounds: int = ROUNDS,
) -> DataFrame:
    """``vectors`` (id long, vec array<double>): (query_id, rank, vec_id, score), the ``k`` rows of the highest inner product found for each
    row that ``is_query``, itself left out; ties go to the smaller id."""
    spark = vectors.sparkSession
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), is_query.alias("asked"))
    rows = written(rows.dropna(subset=["id", "vec"]).filter(fine).withColumn("row", F.monotonically_increasing_id()))
    alike = rows.groupBy("vec").agg(F.bool_or("asked").alias("asked"))
    nodes = written(alike.withColumn("node", F.monotonically_increasing_id()))
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    n, d, longest, asked = nodes.agg(F.count("*"), F.max(F.size("vec")), F.sqrt(F.max(square)), F.count_if("asked")).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    coded = written(_coded(nodes, d, longest))
    graph = neighbour_graph(coded, d, n, degree, deals, leaf, rounds)
    links = written(_links(graph, coded, degree))
    few = [r[0] for r in nodes.orderBy(square.desc(), "node").limit(LONGEST).select("node").collect()]
    own = nodes.filter("asked")
    queries = written(_asked(own, d, longest))
    begin = own.select(F.col("node").alias("query"), F.explode(F.array_distinct(F.concat(F.array("node"), F.array(*map(F.lit, few))))).alias("node"))
    kept = written(greedy_search(queries, begin, links, beam))

    pairs = kept.join(own.select(F.col("node").alias("query"), F.col("vec").alias("x")), "query").join(nodes.select("node", F.col("vec").alias("y")), "node")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    first = _exact(pairs, d).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= k + 1).drop("k")
    # of equal vectors no more than k can follow a query that is one of them
    placed = rows.join(nodes.select("vec", "node"), "vec").select("node", "id", "row", "asked")
    members = placed.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("id", "row"))).filter(F.col("k") <= k + 1)
    met = written(first.join(members.select("node", F.col("id").alias("vec_id"), "row"), "node"))
    askers = placed.filter("asked").select(F.col("node").alias("query"), F.col("id").alias("query_id"), F.col("row").alias("own"))
    order = Window.partitionBy("own").orderBy(F.col("score").desc(), "vec_id", "row")
    out = askers.join(met, "query").filter("own <> row").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest(rows, F.coalesce(F.col("id") % 20 == 0, F.lit(False)))
