"""Scenarios of the miner, the detectors and dampening."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dampening, log_detector, metric_detector, mining
from tidemark.operators.mining import CHANGED, CREATED, SAME, Miner, MinerConfig

S = 1_000_000
NONE = [("NUM", r"(?!)")]


def test_miner_merges_and_creates():
    m = Miner()
    got = [(c.id, change, " ".join(c.template)) for c, change in (m.add(x.split()) for x in ("user bob logged in", "user eve logged in", "user eve logged in", "cache warm", "user 7 logged in"))]
    assert got[:4] == [(1, CREATED, "user bob logged in"), (1, CHANGED, "user <*> logged in"), (1, SAME, "user <*> logged in"), (2, CREATED, "cache warm")]
    assert m.match("user ann logged in".split()).id == 1 and m.match("nothing like it".split()) is None
    assert m.match("cache warm".split(), "always").id == 2


class PlainMiner:
    """The same rules written down anew: clusters in a list by use, a leaf is a path of branches taken when a template came."""

    def __init__(self, config):
        self.c, self.used, self.paths, self.children, self.next = config, [], {}, {}, 1

    def walk(self, words, grow):
        path = (len(words),)
        for word in words[: max(0, min(self.c.depth - 3, len(words) - 1))]:
            below = self.children.setdefault(path, []) if grow else self.children.get(path, [])
            if word in below:
                branch = word
            elif not grow:
                branch = "<*>" if "<*>" in below else None
            elif any(x.isdecimal() for x in word):
                branch = "<*>"
            else:
                others = [b for b in below if b != "<*>"]
                branch = word if len(others) + 1 < self.c.max_children else "<*>"
            if branch is None:
                return None
            if grow and branch not in below:
                below.append(branch)
            path += (branch,)
        return path

    def add(self, words):
        path, found = self.walk(words, False), []
        for cluster in self.used:
            if path is not None and self.paths[cluster["id"]] == path and len(cluster["t"]) == len(words):
                same = sum(a == b and a != "<*>" for a, b in zip(cluster["t"], words, strict=True))
                found.append((same / len(words) if words else 1.0, cluster["t"].count("<*>"), -cluster["id"], cluster))
        best = max(found, key=lambda f: f[:3], default=None)
        if best and best[0] >= self.c.similarity:
            cluster = best[3]
            new = [a if a == b else "<*>" for a, b in zip(cluster["t"], words, strict=True)]
            change = SAME if new == cluster["t"] else CHANGED
            self.used.remove(cluster)
            self.used.append(cluster | {"t": new, "n": cluster["n"] + 1})
            return cluster["id"], change, new
        if self.c.max_clusters and len(self.used) >= self.c.max_clusters:
            self.used.pop(0)
        self.used.append({"id": self.next, "t": list(words), "n": 1})
        self.paths[self.next] = self.walk(words, True)
        self.next += 1
        return self.next - 1, CREATED, list(words)


@pytest.mark.parametrize("depth, children, cap, similarity", [(4, 100, 0, 0.4), (4, 3, 8, 0.4), (5, 4, 20, 0.5), (6, 100, 15, 0.3), (3, 2, 0, 0.7), (8, 3, 0, 0.4)])
def test_miner_brute_force(depth, children, cap, similarity):
    import random

    rng = random.Random(depth * 100 + children)
    shapes = ["link {} is up", "link {} is down", "sent {} bytes to {}", "job {} of {} done in <NUM> ms", "cache", "{}", "{} {}", "retry {} <*> {}", "", "disk {} has {} blocks left on {}"]
    pool = ["eth0", "eth1", "7", "a1", "web", "db", "x", "<*>", "<NUM>"]
    config = MinerConfig(depth, similarity, children, cap)
    mine, plain = Miner(config), PlainMiner(config)
    for _ in range(3000):
        shape = rng.choice(shapes)
        words = shape.format(*(rng.choice(pool) for _ in range(shape.count("{}")))).split()
        cluster, change = mine.add(words)
        assert (cluster.id, change, cluster.template) == plain.add(words)


def test_miner_deep_trees_keep_the_last_word_free():
    m = Miner(MinerConfig(depth=5))
    assert [" ".join(m.add(x.split())[0].template) for x in ("user bob", "user eve", "user ann")] == ["user bob", "user <*>", "user <*>"]


def test_drain_query_brute_force(spark):
    """The registered query against the plain miner over all lines of the table."""
    import re

    from tidemark.functions.templates import MASKS, MAX_TOKENS
    from tidemark.plans import catalogue

    want = {}
    miners = {}
    for d in sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        for line in d["text"].split("\n"):
            if line.strip(" ") == "":
                continue
            for name, pattern in MASKS:
                line = re.sub(pattern, f"<{name}>", line, flags=re.A)
            words = line.split()
            words = [*words[: MAX_TOKENS - 1], "<TRUNCATED>"] if len(words) > MAX_TOKENS else words
            miner = miners.setdefault(d["source"], PlainMiner(MinerConfig()))
            id_, _, template = miner.add(words)
            want[d["source"], str(id_)] = (" ".join(template), want.get((d["source"], str(id_)), ("", 0))[1] + 1)
    got = {(r["source"], r["template_id"]): (r["template"], r["size"]) for r in catalogue.drain_templates(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_miner_evicts_least_recent():
    m = Miner(MinerConfig(max_clusters=2))
    for line in ("a x", "b y", "a x", "c z"):
        m.add(line.split())
    assert sorted(c.id for c in m.clusters.values()) == [1, 3]
    assert m.add("b y".split())[1] == CREATED


def test_miner_numbers_and_crowded_nodes():
    m = Miner(MinerConfig(max_children=3))
    for k in range(6):
        m.add([f"v{k}", "same", "rest", "of", "line"])
    for k in "abcdef":
        m.add([k, "other", "rest", "of", "it"])
    assert "<*>" in m.lengths[5].children and len(m.lengths[5].children) <= 3


def test_miner_restores():
    m = Miner()
    lines = ["user bob in", "user eve in", "disk full on x", "disk full on y", "user 4 in", "other thing entirely now"]
    for line in lines[:3]:
        m.add(line.split())
    again = Miner.restored(m.snapshot())
    assert [(c.id, ch, c.template, c.size) for c, ch in map(again.add, map(str.split, lines[3:]))] == [(c.id, ch, c.template, c.size) for c, ch in map(m.add, map(str.split, lines[3:]))]


@pytest.mark.parametrize("limit", [0, 8])
def test_miner_goes_on_from_its_state(limit):
    """A saved miner goes on as if it hadn't been saved, nodes that are full and clusters that have gone among what it knows."""
    rng = random.Random(limit)
    config = MinerConfig(max_clusters=limit, max_children=3)
    lines = [[rng.choice("abcdef") * 2, rng.choice("xyz1"), *rng.choices("pqrstuv", k=rng.randrange(5))] for _ in range(600)]
    whole, fold = mining._Mining(config), mining._Mining(config)
    want = [list(whole.step(k, w))[0][2:] for k, w in enumerate(lines)]
    got = []
    for k, w in enumerate(lines):
        if k % 97 == 50:
            saved = dict(zip(("last_id", "clusters", "ways"), fold.state()))
            fold = mining._Mining(config)
            fold.restore(saved)
        got += [x[2:] for x in fold.step(k, w)]
    assert got == want and sum(x[1] == CREATED for x in want) > 20


def test_mine_and_match(spark):
    rows = [("s", k, f"GET /p{k} took {k} ms") for k in range(5)] + [("s", 9, "")]
    lines = spark.createDataFrame(rows, "source string, seq long, message string")
    mined = mining.mine(lines, ["seq"], "seq")
    got = {r["seq"]: r for r in mined.collect()}
    assert got[4]["template"] == "GET <*> took <NUM> ms" and got[4]["parameters"] == ["/p4", "<NUM>"] and got[4]["cluster_size"] == 5
    table = mining.template_table(mined, F.col("seq"))
    assert {(r["template"], r["size"]) for r in table.collect()} == {("GET <*> took <NUM> ms", 5), ("", 1)}
    words = spark.createDataFrame([("s", ["GET", "x", "took", "<NUM>", "ms"]), ("s", ["GET", "x"])], "source string, words array<string>")
    assert {len(r["words"]): r["template_id"] for r in mining.match_templates(words, table).collect()} == {5: "1", 2: None}


@pytest.mark.parametrize("limit", [0, 400, 25, 6])
def test_mining_by_length_equals_one_miner(spark, limit):
    """Numbers and the limit on clusters reach over all lengths of a source: they give what one miner gives, where the limit is hit often too."""
    rng = random.Random(limit)
    shapes = [["job", "{w}", "done"], ["open", "{w}", "by", "{w}"], ["a{r}", "x"], ["b{r}", "y", "z"], ["c{r}", "{w}", "q", "r", "s"], ["{w}"]]
    rows = []
    for k in range(1500):
        r = int(rng.paretovariate(0.7)) % 60
        rows.append((rng.choice("st"), k, " ".join(rng.choice(shapes)).format(w=rng.choice(["u", "v", "w", "x1"]), r=chr(97 + r % 26) * (1 + r // 26))))
    config = MinerConfig(max_clusters=limit)
    miners, want = {"s": Miner(config), "t": Miner(config)}, {}
    for source, k, line in rows:
        cluster, change = miners[source].add(line.split())
        want[source, k] = (str(cluster.id), change, " ".join(cluster.template), cluster.size)
    lines = spark.createDataFrame(rows, "source string, k long, message string").withColumn("seq", F.struct("k")).withColumn("ts", F.timestamp_seconds("k"))
    mined = mining.mine(lines, ["ts"], "seq", config, masks=NONE, carry=("k",))
    got = {(r["source"], r["k"]): (r["template_id"], r["change_type"], r["template"], r["cluster_size"]) for r in mined.collect()}
    assert got == want
    if limit == 6:
        assert max(int(x[0]) for x in want.values()) > 300  # clusters come and go


def test_drain_query_mines_crowded_sources_once(spark, monkeypatch, tmp_path):
    """A source over the limit of 2,000 clusters, whose lines come back after theirs have gone: one miner's clusters, by two folds in all."""
    from tidemark.plans import catalogue

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    lines = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(2600)]
    lines += [rng.choice(lines) for _ in range(600)] + [" ".join([x.split()[0], word(), *x.split()[2:]]) for x in rng.sample(lines, 400)]
    rows = [(k, "crowded", x) for k, x in enumerate(lines)] + [(k, rng.choice(["calm", None]), f"job {k % 3} of {word()} is done\n\n{word()}") for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    miners, want = {}, {}
    for _, source, text in rows:
        for line in filter(None, text.split("\n")):
            words = ["<NUM>" if w.isdecimal() else w for w in line.split()]
            cluster, _ = miners.setdefault(source, Miner()).add(words)
            want[source, str(cluster.id)] = (" ".join(cluster.template), cluster.size)
    folds, fold = [], mining.keyed_fold
    monkeypatch.setattr(mining, "keyed_fold", lambda *a, **b: (folds.append(a[1]), fold(*a, **b))[1])
    got = catalogue.drain_templates(spark, str(tmp_path)).collect()
    assert {(r["source"], r["template_id"]): (r["template"], r["size"]) for r in got} == want and len(got) == len(want)
    assert len(miners["crowded"].clusters) == 2000 and miners["crowded"].last_id > 2500
    assert folds == [["source", "_n"], ["source"]]


@pytest.mark.parametrize("limit", [0, 5])
def test_templates_told_once_equal_the_table_of_lines(spark, limit):
    """Each cluster once, as the rows of ``mine`` leave it; lines at one place go by their words."""
    rng = random.Random(limit)
    rows = [(rng.choice("st"), k, " ".join(rng.choices(["up", "down", "link", "<*>"], k=rng.randrange(4)))) for k in range(300)]
    lines = spark.createDataFrame(rows, "source string, seq long, message string")
    config = MinerConfig(max_clusters=limit)
    told = lambda df: sorted((r["source"], r["template_id"], r["template"], r["size"]) for r in df.collect())
    want = told(mining.template_table(mining.mine(lines, ["seq"], "seq", config), F.struct("cluster_size", "template")))
    assert told(mining.mined_templates(lines, ["seq"], config)) == want
    both = lines.withColumn("seq", F.lit(1))
    assert told(mining.mined_templates(both, ["seq"], config)) == told(mining.mined_templates(both.orderBy(F.rand(7)), ["seq"], config))


def run(series, samples, **kw):
    out = []
    for k, (ts, v) in enumerate(samples):
        out += [(k, kind) for row in series.step(k, ts, v, kw.get("least", 0.0), kw.get("high"), kw.get("low"), kw.get("ignored", False)) for kind in row[10]]
    return out


def test_metric_warmup_and_zscore():
    steady = [(k * S, 10 + k % 2) for k in range(40)]
    assert run(metric_detector.Series(), steady) == []
    assert (40, metric_detector.ZSCORE) in run(metric_detector.Series(), [*steady, (40 * S, 100.0)])
    assert run(metric_detector.Series(), [*steady[:10], (40 * S, 100.0)]) == []
    assert run(metric_detector.Series(), [*steady, (40 * S, 100.0)], least=200.0) == []
    assert run(metric_detector.Series(), [*steady, (40 * S, 100.0)], ignored=True, high=1.0) == []


def test_metric_threshold_and_not_finite():
    assert run(metric_detector.Series(), [(0, 95.0)], high=90.0) == [(0, metric_detector.THRESHOLD)]
    assert run(metric_detector.Series(), [(0, 90.0)], high=90.0) == []
    assert run(metric_detector.Series(), [(0, float("nan")), (1, None)], high=1.0) == []


def test_metric_drift_latches():
    up = [(k * S, 10.0) for k in range(40)] + [((40 + k) * S, 40.0) for k in range(20)]
    assert [kind for _, kind in run(metric_detector.Series(), up)].count(metric_detector.DRIFT) == 1


def test_metric_daily_recurrence():
    day = [(m * 60 * S, 1.5 + 0.1 * (m % 3)) for m in range(1440)]
    samples = []
    for d in range(5):
        for m, (ts, v) in enumerate(day):
            odd = m == 720 if d < 4 else m == 180
            samples.append((ts + d * metric_detector.DAY, 45.0 if odd else v))
    found = [(k // 1440, kind) for k, kind in run(metric_detector.Series(), samples) if kind == metric_detector.ZSCORE]
    assert [d for d, _ in found] == [0, 1, 4]


def test_metric_ttl():
    s = metric_detector.Series()
    run(s, [(k * S, 1.0) for k in range(5)])
    run(s, [(8 * metric_detector.DAY, 1.0)])
    assert s.n == 1


def logs(source, rows):
    """rows: (ts in seconds, template, change, marking)."""
    return [(k, kind) for k, (ts, t, change, marking) in enumerate(rows) for _, _, kind, *_ in source.step(k, int(ts * S), t, t, change, marking, True)]


def test_log_new_after_learning():
    rows = [(0, "a", CREATED, None), (120, "b", CREATED, None), (400, "c", CREATED, None)]
    assert logs(log_detector.Source(), rows) == [(2, log_detector.NEW)]


def test_log_rare():
    rows = [(k, "common", SAME, None) for k in range(600)] + [(601, "x", CREATED, None), (602, "x", SAME, None), (603, "x", SAME, None), (604, "x", SAME, None)]
    assert [kind for _, kind in logs(log_detector.Source(log_detector.LogConfig(learning_us=0, spike_factor=1e9)), rows)] == [log_detector.NEW, log_detector.RARE, log_detector.RARE]


def test_log_spike_once_a_bucket():
    rows = [(60 * m + k * 10, "t", SAME, None) for m in range(20) for k in range(2)] + [(1200 + k * 0.5, "t", SAME, None) for k in range(60)]
    assert [kind for _, kind in logs(log_detector.Source(), rows)].count(log_detector.SPIKE) == 1


def test_log_missing_heartbeat_latches():
    rows = [(10 * k, "beat", SAME, "heartbeat") for k in range(30)] + [(400 + 10 * k, "other", SAME, "normal") for k in range(40)]
    assert logs(log_detector.Source(), rows) == []  # normal rows don't scan
    rows = [r[:3] + (None if r[1] == "other" else r[3],) for r in rows]
    assert [kind for _, kind in logs(log_detector.Source(log_detector.LogConfig(learning_us=10**12)), rows)] == [log_detector.MISSING]
    assert logs(log_detector.Source(log_detector.LogConfig(learning_us=10**12)), [r[:3] + (None,) for r in rows]) == []


def test_log_markings():
    rows = [(0, "a", CREATED, "symptomatic"), (1, "b", CREATED, "ignore"), (2, "a", SAME, "symptomatic")]
    assert logs(log_detector.Source(), rows) == [(0, log_detector.SYMPTOM), (2, log_detector.SYMPTOM)]


def test_log_template_cap():
    s = log_detector.Source(log_detector.LogConfig(max_templates=3))
    logs(s, [(k, f"t{k}", CREATED, None) for k in range(10)])
    assert sorted(s.templates) == ["t7", "t8", "t9"]


def reports(rows, **kw):
    p = dampening.Pattern(dampening.DampenConfig(**kw))
    return [(k, out[4], out[5], out[6]) for k, (ts, score) in enumerate(rows) for out in p.step(k, int(ts * S), score) if out[3]]


def test_dampening():
    spikes = [(20 * 60 * k, 0.66) for k in range(22)]
    got = reports(spikes)
    assert 2 <= len(got) <= 5 and got[0] == (0, 0, 0, None) and got[1][:3] == (3, 2, 1)
    assert reports([(0, 0.5), (60, 0.62), (120, 0.65)]) == [(0, 0, 0, None), (1, 0, 0, 0.5)]
    assert len(reports([(k, 0.5) for k in range(5)], cooldown_us=0)) == 5
    assert reports([(0, 0.5), (2 * 86400, 0.5)]) == [(0, 0, 0, None), (1, 0, 0, None)]


@pytest.mark.parametrize("order", [1, -1])
def test_dampen_frame_takes_rows_in_order(spark, order):
    t0 = datetime(2026, 1, 1)
    rows = [("k", "s", "p", i, t0 + timedelta(minutes=20 * i), 0.66) for i in range(22)][::order]
    df = spark.createDataFrame(rows, "kind string, source string, pattern string, seq long, ts timestamp, score double")
    assert sorted(r["seq"] for r in dampening.dampen(df).filter("reported").collect()) == [k for k, *_ in reports([(20 * 60 * k, 0.66) for k in range(22)])]
