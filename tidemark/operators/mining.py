"""Online template mining of log messages, one miner a source.

A message joins the most similar template among those that its prefix leads to, whose differing words
become ``<*>``, or starts a template of its own.  The prefix is the number of words and the first words.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.templates import PARAM, mask, parameters, tokens
from tidemark.operators.folds import Resume, keyed_fold
from tidemark.shared import running, written

CREATED, CHANGED, SAME = "cluster_created", "cluster_template_changed", "none"
MATCHED = "cluster_id long, change_type string, template array<string>, size long"


@dataclass(frozen=True)
class MinerConfig:
    depth: int = 4
    similarity: float = 0.4
    max_children: int = 100
    max_clusters: int = 2000  # 0: no limit
    numbers_are_parameters: bool = True


#: The sign that no word has: that of a parameter in a template.
_HOLE = 255


def _signs(words: list[str]) -> np.ndarray:
    return np.frombuffer(bytes([hash(w) % _HOLE for w in words]), np.uint8)


def _template_signs(template: list[str], signs: np.ndarray) -> np.ndarray:
    """Those of a template of words that have ``signs``."""
    return np.where([w == PARAM for w in template], _HOLE, signs).astype(np.uint8) if PARAM in template else signs


class _Table:
    """The templates of a node as columns of word signs, so that a message is compared with all of them at once.

    Equal words have equal signs, so a column has as many signs equal as its template has words, or more; the words decide.
    """

    def __init__(self, width: int) -> None:
        self.signs = np.full((width, 4), _HOLE, np.uint8)
        self.holes, self.ids = np.zeros(4, np.int64), np.zeros(4, np.int64)
        self.owners: list[Cluster | None] = []
        self.free: list[int] = []
        self.counts = np.uint8 if width < 256 else np.int64

    def put(self, cluster: Cluster, signs: np.ndarray) -> None:
        if self.free:
            at = self.free.pop()
            self.owners[at] = cluster
        else:
            at = len(self.owners)
            self.owners.append(cluster)
            if at == len(self.ids):
                self.signs = np.concatenate([self.signs, np.full_like(self.signs, _HOLE)], axis=1)
                self.holes, self.ids = (np.concatenate([x, np.zeros_like(x)]) for x in (self.holes, self.ids))
        self.signs[:, at], self.holes[at], self.ids[at] = signs, cluster.holes, cluster.id
        cluster.home = (self, at)

    def take(self, at: int) -> None:
        self.signs[:, at], self.owners[at] = _HOLE, None
        self.free.append(at)

    def nearest(self, words: list[str], signs: np.ndarray, needed: int, count_parameters: bool = False) -> Cluster | None:
        """The cluster with the most words equal, of these the one with the most parameters, of these the first; None under ``needed``."""
        n = len(self.owners)
        own = self.signs[:, :n]
        same = own == signs[:, None]
        if count_parameters:
            same |= own == _HOLE
        counts = np.add.reduce(same.view(np.uint8), axis=0, dtype=self.counts)
        if n == 0 or counts.max() < needed:
            return None
        able = np.flatnonzero(counts >= needed)
        able = able[np.lexsort((self.ids[able], -self.holes[able], -counts[able].astype(np.int64)))]
        best, most = None, (needed, -1, 0)
        for at in able.tolist():
            cluster = self.owners[at]
            if cluster is None:
                continue
            if (int(counts[at]), cluster.holes, -cluster.id) < most:
                break
            equal = sum(a == b != PARAM for a, b in zip(cluster.template, words, strict=True)) + cluster.holes * count_parameters
            if (equal, cluster.holes, -cluster.id) > most:
                best, most = cluster, (equal, cluster.holes, -cluster.id)
        return best


@dataclass
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)
    table: _Table | None = None


@dataclass
class Cluster:
    id: int
    template: list[str]
    size: int = 1
    holes: int = 0
    branch: list[str] = field(default_factory=list, repr=False, compare=False)  # the words that lead to its node
    home: tuple[_Table, int] | None = field(default=None, repr=False, compare=False)  # its node's table and its place there

    def __post_init__(self) -> None:
        self.holes = self.template.count(PARAM)


class Miner:
    """Clusters by recency of use, and a prefix tree over their templates."""

    def __init__(self, config: MinerConfig = MinerConfig()) -> None:
        self.config = config
        self.clusters: OrderedDict[int, Cluster] = OrderedDict()
        self.lengths: dict[int, _Node] = {}
        self.last_id = 0
        self.needed: dict[tuple[int, float], int] = {}

    def add(self, words: list[str]) -> tuple[Cluster, str]:
        leaf = self._leaf(words)
        signs = _signs(words)
        cluster = self._nearest(leaf, words, signs, self.config.similarity) if leaf else None
        if cluster is None:
            self.last_id += 1
            cluster = Cluster(self.last_id, list(words))
            if 0 < self.config.max_clusters <= len(self.clusters):
                self.drop(next(iter(self.clusters)))
            self.clusters[cluster.id] = cluster
            self._insert(cluster, signs)
            return cluster, CREATED
        template = [a if a == b else PARAM for a, b in zip(cluster.template, words, strict=True)]
        change = SAME if template == cluster.template else CHANGED
        cluster.size += 1
        if change == CHANGED:
            cluster.template, cluster.holes = template, template.count(PARAM)
            table, at = cluster.home
            table.signs[:, at], table.holes[at] = _template_signs(template, signs), cluster.holes
        self.clusters.move_to_end(cluster.id)
        return cluster, change

    def match(self, words: list[str], strategy: str = "never") -> Cluster | None:
        """The template that ``words`` fit but for its parameters; ``strategy``: never, fallback or always search all of that length."""
        found = None
        if strategy != "always":
            leaf = self._leaf(words)
            found = self._nearest(leaf, words, _signs(words), 1.0, True) if leaf else None
        if found is None and strategy != "never":
            same_length = [c.id for c in self.clusters.values() if len(c.template) == len(words)]
            found = self._closest(same_length, words, 1.0, True)
        return found

    def _steps(self, words: list[str]) -> list[str]:
        """The words that lead through the tree; the last word never does."""
        return words[: max(0, min(self.config.depth - 3, len(words) - 1))]

    def _leaf(self, words: list[str]) -> _Node | None:
        node = self.lengths.get(len(words))
        for word in self._steps(words):
            if node is None:
                return None
            node = node.children.get(word) or node.children.get(PARAM)
        return node

    def drop(self, id_: int) -> Cluster | None:
        """Forgets a cluster."""
        cluster = self.clusters.pop(id_, None)
        if cluster is not None:
            cluster.home[0].take(cluster.home[1])
        return cluster

    def _least(self, n: int, least: float) -> int:
        """The fewest equal words of ``n`` that reach the limit, as the quotient does."""
        needed = self.needed.get((n, least))
        if needed is None:
            needed = self.needed[n, least] = next((k for k in range(n + 1) if k / n >= least), n + 1) if n else 0
        return needed

    def _nearest(self, node: _Node, words: list[str], signs: np.ndarray, least: float, count_parameters: bool = False) -> Cluster | None:
        """As ``_closest`` over the clusters of a node."""
        if node.table is None:
            return None
        return node.table.nearest(words, signs, self._least(len(words), least), count_parameters)

    def _closest(self, ids: list[int], words: list[str], least: float, count_parameters: bool = False) -> Cluster | None:
        """The cluster with the most words equal, of these the one with the most parameters, of these the first; None under ``least``."""
        n, both = len(words), PARAM in words
        best, most, most_holes = None, -1, -1
        needed = self._least(n, least)
        for id_ in ids:
            cluster = self.clusters.get(id_)
            if cluster is None:
                continue
            holes = cluster.holes
            # no more words can be equal than the template has, but those counted as such
            if not count_parameters and n - holes < max(most, needed):
                continue
            equal = sum(map(eq, cluster.template, words))
            if both:
                equal -= sum(a == PARAM == b for a, b in zip(cluster.template, words, strict=True))
            if count_parameters:
                equal += holes
            if equal > most or (equal == most and holes > most_holes):
                best, most, most_holes = cluster, equal, holes
        return best if most >= needed else None

    def _insert(self, cluster: Cluster, signs: np.ndarray) -> None:
        node = self.lengths.setdefault(len(cluster.template), _Node())
        cluster.branch = []
        for word in self._steps(cluster.template):
            cluster.branch.append(self._branch(node, word))
            node = node.children.setdefault(cluster.branch[-1], _Node())
        self._place(node, cluster, signs)

    def _place(self, node: _Node, cluster: Cluster, signs: np.ndarray) -> None:
        if node.table is None:
            node.table = _Table(len(cluster.template))
        node.table.put(cluster, _template_signs(cluster.template, signs))

    def _branch(self, node: _Node, word: str) -> str:
        """The child of ``node`` that a new template's word goes to."""
        if word in node.children:
            return word
        if self.config.numbers_are_parameters and any(map(str.isdecimal, word)):
            return PARAM
        # the last place is kept for the child that takes all others
        room = self.config.max_children - len(node.children) - (PARAM not in node.children)
        return word if room > 0 else PARAM

    def snapshot(self) -> list[tuple[int, list[str], int]]:
        """Clusters, the least recently used first."""
        return [(c.id, c.template, c.size) for c in self.clusters.values()]

    @classmethod
    def restored(cls, clusters: list[tuple[int, list[str], int]], config: MinerConfig = MinerConfig()) -> Miner:
        out = cls(config)
        for id_, template, size in clusters:
            out.clusters[id_] = cluster = Cluster(id_, list(template), size)
            out.last_id = max(out.last_id, id_)
            out._insert(cluster, _signs(template))
        return out


class _Mining:
    #: Clusters from the least to the most recently used, and all ways through the tree, those to nodes without clusters too.
    STATE = "last_id long, clusters array<struct<id:bigint,template:array<string>,size:bigint,branch:array<string>>>, ways array<struct<n:int,branch:array<string>>>"

    def __init__(self, config: MinerConfig) -> None:
        self.miner = Miner(config)

    def state(self) -> tuple:
        ways: list[dict] = []

        def walk(n: int, node: _Node, branch: list[str]) -> None:
            if not node.children:
                ways.append({"n": n, "branch": branch})
            for word, child in node.children.items():
                walk(n, child, [*branch, word])

        for n, node in self.miner.lengths.items():
            walk(n, node, [])
        return self.miner.last_id, [{"id": c.id, "template": c.template, "size": c.size, "branch": c.branch} for c in self.miner.clusters.values()], ways

    def restore(self, state: dict) -> None:
        m = self.miner
        m.last_id = state["last_id"]
        for way in state["ways"]:
            node = m.lengths.setdefault(way["n"], _Node())
            for word in way["branch"]:
                node = node.children.setdefault(word, _Node())
        for c in state["clusters"]:
            m.clusters[c["id"]] = Cluster(c["id"], list(c["template"]), c["size"], branch=list(c["branch"]))
        for cluster in sorted(m.clusters.values(), key=lambda c: c.id):  # as they came into their nodes
            node = m.lengths.setdefault(len(cluster.template), _Node())
            for word in cluster.branch:
                node = node.children.setdefault(word, _Node())
            m._place(node, cluster, _signs(cluster.template))

    def step(self, seq, words: list[str], *carried) -> Iterator[tuple]:
        cluster, change = self.miner.add(words)
        yield seq, words, cluster.id, change, list(cluster.template), cluster.size, *carried

    def finish(self) -> Iterator[tuple]:
        return iter(())


class _OneLength:
    """The miner of a source's messages of one number of words; clusters go when they are told to as well.

    What the limit takes here would go under the limit of the whole source too, at that time or before.
    """

    def __init__(self, config: MinerConfig) -> None:
        self.miner = Miner(config)

    def step(self, gone: int | None, seq, words: list[str], *carried) -> Iterator[tuple]:
        if gone is not None:
            self.miner.drop(gone)
            return
        cluster, change = self.miner.add(words)
        yield seq, words, cluster.id, change, list(cluster.template), cluster.size, *carried

    def finish(self) -> Iterator[tuple]:
        return iter(())


class _Recency:
    """Which cluster of a source goes when another begins: the one that was used least recently; and which were used after they had gone."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.used: OrderedDict[tuple[int, int], None] = OrderedDict()

    def step(self, n: int, cluster: int, created: bool, *at) -> Iterator[tuple]:
        if (n, cluster) not in self.used:
            if not created:
                yield n, None, *at
            if len(self.used) >= self.limit:
                yield *self.used.popitem(last=False)[0], *at
        self.used[n, cluster] = None
        self.used.move_to_end((n, cluster))

    def finish(self) -> Iterator[tuple]:
        return iter(())


class _Templates:
    """The miner of a source's messages, that gives each cluster once: as it is when it goes, or at the end.

    ``part``: of one number of words of a source.  Where that alone has more clusters than the limit, nothing is told but this.
    """

    def __init__(self, config: MinerConfig, part: bool) -> None:
        self.limit, self.part, self.over = config.max_clusters, part, False
        self.miner = Miner(replace(config, max_clusters=0))
        self.begun: dict[int, tuple] = {}  # the first messages' places

    def step(self, line: str, *at) -> Iterator[tuple]:
        if self.over:
            return
        cluster, change = self.miner.add(line.split(" ") if line else [])
        if change != CREATED:
            return
        if self.part:
            self.begun[cluster.id] = (*at, line)
        if 0 < self.limit < len(self.miner.clusters):
            if self.part:
                self.over = True
            else:
                yield self.row(self.miner.drop(next(iter(self.miner.clusters))))

    def row(self, cluster: Cluster) -> tuple:
        return cluster.id, " ".join(cluster.template), cluster.size, *self.begun.get(cluster.id, ())

    def finish(self) -> Iterator[tuple]:
        if self.over:
            last = next(reversed(self.begun))
            yield None, None, None, *self.begun[last]
        else:
            yield from map(self.row, self.miner.clusters.values())


#: Times that sources over the limit of clusters are mined by lengths, before what isn't settled is mined source by source.
ROUNDS = 4


def _typed(df: DataFrame, columns: list[str], names: list[str] | None = None) -> str:
    return "".join(f", {name} {df.schema[c].dataType.simpleString()}" for c, name in zip(columns, names or columns, strict=True))


class _Parallel:
    """Mining by source and number of words: messages of different lengths never meet in a tree.

    What lengths share is the numbering of clusters and the limit on how many there are.  Numbers follow from the order of first
    messages.  Where a source has more clusters than the limit, a pass over (length, cluster) in order tells which of
    them go when.  A cluster that no message joins after it has gone makes no difference; lengths in which one does are mined
    again, with what goes when told.  Up to the first such message a round is right, so each is right for longer, and once what was told is what follows it is the result.
    """

    def __init__(self, rows: DataFrame, order: list[str], seq: str, config: MinerConfig, carry: tuple[str, ...]) -> None:
        self.seq, self.config, self.carry = seq, config, carry
        self.at = [f"_at{k}" for k in range(len(order) + 1)]  # the place of a message in its source
        self.rows = rows.select(
            "source", F.size("words").alias("_n"), F.lit(None).cast("int").alias("_gone"), seq, "words", *carry, *[F.col(c).alias(a) for c, a in zip([*order, seq], self.at, strict=True)]
        )
        kind = rows.schema[seq].dataType.simpleString()
        self.ddl = f"{seq} {kind}, words array<string>, {MATCHED}{_typed(rows, list(carry))}{_typed(self.rows, self.at)}"

    def by_length(self, rows: DataFrame) -> DataFrame:
        config, columns = self.config, ["_gone", self.seq, "words", *self.carry, *self.at]
        return keyed_fold(rows, ["source", "_n"], [*self.at, "_gone"], columns, lambda: _OneLength(config), self.ddl)

    def goes(self, found: DataFrame) -> DataFrame:
        """(source, n, gone, _at...): the clusters that go, and where; without ``gone``, messages that join a cluster that has gone."""
        limit = self.config.max_clusters
        rows = found.select("source", "_n", "cluster_id", (F.col("change_type") == CREATED).alias("_new"), *self.at)
        return keyed_fold(rows, ["source"], self.at, ["_n", "cluster_id", "_new", *self.at], lambda: _Recency(limit), f"n int, gone long{_typed(self.rows, self.at)}")

    def result(self) -> DataFrame:
        found = written(self.by_length(self.rows))
        if self.config.max_clusters > 0:
            created = found.filter(F.col("change_type") == CREATED).groupBy("source").count()
            over = written(created.filter(F.col("count") > self.config.max_clusters).select("source"))
            if not over.isEmpty():
                found = self.limited(found, over)
        # numbers by first messages, over all lengths of a source
        begun = found.filter(F.col("change_type") == CREATED).select("source", "_n", "cluster_id", *self.at)
        placed = written(running(begun, ["source", *self.at], {"_k": F.lit(1).cast("long")}))
        first = placed.groupBy("source").agg(F.min("_k").alias("_first"))
        numbered = placed.join(first, "source").select("source", "_n", "cluster_id", (F.col("_k") - F.col("_first") + 1).alias("_id"))
        return found.join(numbered, ["source", "_n", "cluster_id"]).drop("cluster_id", *self.at).withColumnRenamed("_id", "cluster_id")

    def limited(self, found: DataFrame, over: DataFrame) -> DataFrame:
        group = ["source", "_n"]
        done, open_ = [found.join(over, "source", "left_anti")], over
        found = found.join(over, "source", "left_semi")
        told = written(self.goes(found).withColumnRenamed("n", "_n"))
        heard = self._sums(told.limit(0))
        for turn in range(ROUNDS + 1):
            # lengths that were told something else than what follows, or nothing though it matters
            late = told.filter("gone is null").select(*group).distinct().withColumn("_late", F.lit(True))
            now = self._sums(told.filter("gone is not null"))
            both = now.join(heard.withColumnsRenamed({"n": "h_n", "sum": "h_sum"}), group, "full").join(late, group, "full")
            wrong = written(both.filter(F.col("_late") | (F.col("h_n").isNotNull() & ~(F.col("n").eqNullSafe(F.col("h_n")) & F.col("sum").eqNullSafe(F.col("h_sum"))))).select(*group))
            unsettled = written(wrong.select("source").distinct())
            done.append(found.join(unsettled, "source", "left_anti").join(open_, "source", "left_semi"))
            open_ = unsettled
            if open_.isEmpty():
                return reduce(DataFrame.unionByName, done)
            if turn == ROUNDS:
                break
            marks = told.filter("gone is not null").join(wrong, group, "left_semi").select(*group, F.col("gone").cast("int").alias("_gone"), *self.at)
            again = self.by_length(self._lines(found).join(wrong, group, "left_semi").unionByName(marks, allowMissingColumns=True))
            found = found.join(open_, "source", "left_semi").join(wrong, group, "left_anti").unionByName(written(again))
            heard = written(heard.join(open_, "source", "left_semi").join(wrong, group, "left_anti").unionByName(now.join(wrong, group, "left_semi")))
            told = written(self.goes(found).withColumnRenamed("n", "_n"))
        config, carried = self.config, [*self.carry, *self.at]
        rest = self._lines(found).join(open_, "source", "left_semi")
        whole = keyed_fold(rest, ["source"], self.at, [self.seq, "words", *carried], lambda: _Mining(config), self.ddl)
        return reduce(DataFrame.unionByName, [*done, written(whole.withColumn("_n", F.size("words")))])

    def _lines(self, found: DataFrame) -> DataFrame:
        """The messages again, from what was written of them."""
        return found.select("source", "_n", F.lit(None).cast("int").alias("_gone"), self.seq, "words", *self.carry, *self.at)

    def _sums(self, told: DataFrame) -> DataFrame:
        """What lengths are told, in a row each that differs if it does."""
        return told.groupBy("source", "_n").agg(F.count("*").alias("n"), F.sum(F.xxhash64("gone", *self.at).cast("decimal(38,0)")).alias("sum"))


def mine(lines: DataFrame, order: list[str], seq: str, config: MinerConfig = MinerConfig(), masks=None, carry: tuple[str, ...] = (), resume: Resume | None = None) -> DataFrame:
    """``lines`` (source, message, ``order``, ``seq``): per row its template after the row, and its parameters.

    ``seq`` identifies a row within its source; the columns of ``carry`` come along.  A source's lines are mined by number of words, in a task each.
    ``resume``: goes on where an earlier run ended; the miner's state is that of a source, so one task mines it.
    """
    masked = mask(F.col("message")) if masks is None else mask(F.col("message"), masks)
    rows = lines.withColumn("words", F.coalesce(tokens(masked), F.array().cast("array<string>")))
    if resume is None:
        found = _Parallel(rows, order, seq, config, carry).result()
    else:
        ddl = f"{seq} {lines.schema[seq].dataType.simpleString()}, words array<string>, {MATCHED}{_typed(lines, list(carry))}"
        found = keyed_fold(rows, ["source"], order, [seq, "words", *carry], lambda: _Mining(config), ddl, resume)
    return found.select(
        "source",
        seq,
        F.col("cluster_id").cast("string").alias("template_id"),
        F.array_join("template", " ").alias("template"),
        parameters(F.col("template"), F.col("words")).alias("parameters"),
        "change_type",
        F.col("size").alias("cluster_size"),
        *carry,
    )


def mined_templates(lines: DataFrame, order: list[str], config: MinerConfig = MinerConfig(), masks=None) -> DataFrame:
    """(source, template_id, template, size): ``template_table`` of what ``mine`` gives for ``lines`` (source, message, ``order``), each cluster told once.

    Lines at one place of a source are taken in the order of their words.  Sources are mined by number of words, in a task each; one that has more clusters
    than the limit, where lengths depend on each other, in a pass over all its lines, and its lengths stop once one has more by itself.
    """
    masked = mask(F.col("message")) if masks is None else mask(F.col("message"), masks)
    words = F.coalesce(tokens(masked), F.array().cast("array<string>"))
    rows = written(lines.select("source", *order, words.alias("_words")).select("source", F.size("_words").alias("_n"), F.array_join("_words", " ").alias("_line"), *order))
    kind, at = "id long, template string, size long", [f"_at{k}" for k in range(len(order) + 1)]
    begun = _typed(rows, [*order, "_line"], at)
    parts = written(keyed_fold(rows, ["source", "_n"], [*order, "_line"], ["_line", *order], lambda: _Templates(config, True), kind + begun))
    counts = parts.groupBy("source").agg(F.count("*").alias("n"), F.bool_or(F.col("id").isNull()).alias("over"))
    over = written(counts.filter(F.col("over") | (F.col("n") > config.max_clusters if config.max_clusters > 0 else F.lit(False))).select(F.col("source").alias("_over")))
    same = F.col("source").eqNullSafe(F.col("_over"))
    numbered = parts.join(over, same, "left_anti").withColumn("id", F.row_number().over(Window.partitionBy("source").orderBy(*at)))
    out = numbered.select("source", F.col("id").cast("long").alias("id"), "template", "size")
    if not over.isEmpty():
        rest = rows.join(over, same, "left_semi")
        out = out.union(keyed_fold(rest, ["source"], [*order, "_line"], ["_line", *order], lambda: _Templates(config, False), kind))
    return out.select("source", F.col("id").cast("string").alias("template_id"), "template", "size")


def template_table(mined: DataFrame, order: Column) -> DataFrame:
    """(source, template_id, template, size) as they stand after all rows of ``mined``."""
    last = F.max_by(F.struct("template", "cluster_size"), order)
    return mined.groupBy("source", "template_id").agg(last.alias("last")).select(
        "source", "template_id", F.col("last.template").alias("template"), F.col("last.cluster_size").alias("size")
    )


def match_templates(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """``messages`` (source, words, ...) with the template_id of the template of their source that they fit, or null.

    Templates (source, template_id, template) meet messages on source, number of words and first word or a
    parameter there; of several that fit, the one with the most parameters counts, then the smallest id.
    """
    own = templates.select(
        F.col("source").alias("t_source"),
        "template_id",
        F.split("template", " ").alias("t_words"),
    ).withColumn("t_first", F.col("t_words")[0]).withColumn("t_n", F.size("t_words"))
    rows = messages.withColumn("_row", F.monotonically_increasing_id())
    keys = rows.select("_row", "source", "words", F.explode(F.array(F.get("words", F.lit(0)), F.lit(PARAM))).alias("first"))
    fits = F.forall(F.arrays_zip(F.col("t_words").alias("t"), F.col("words").alias("w")), lambda p: (p["t"] == PARAM) | (p["t"] == p["w"]))
    pairs = keys.join(
        own, (F.col("source") == F.col("t_source")) & (F.col("first") == F.col("t_first")) & (F.size("words") == F.col("t_n")) & fits
    )
    holes = F.size(F.filter("t_words", lambda w: w == PARAM))
    best = pairs.groupBy("_row").agg(F.min_by("template_id", F.struct(-holes, F.col("template_id").cast("long"))).alias("template_id"))
    return rows.join(best, "_row", "left").drop("_row")
