"""Limits over keys against the rule followed row by row."""

import random

import pytest

from tidemark.operators import caps, dampening, metric_detector
from tidemark.operators.folds import Resume
from tidemark.shared import new_path


def plain(keys, most, drop):
    """Whether each key isn't remembered when it comes."""
    seen, out = {}, []
    for at, key in enumerate(keys):
        out.append(key not in seen)
        if key not in seen and len(seen) >= most:
            for old in sorted(seen, key=seen.get)[:drop]:
                del seen[old]
        seen[key] = at
    return out


def draws(rng, n, shape):
    if shape == "hot":
        return [0 if rng.random() < 0.4 else rng.randrange(60) for _ in range(n)]
    if shape == "drifting":
        return [i // 9 + rng.randrange(25) for i in range(n)]
    if shape == "round":
        return [i % 23 for i in range(n)]
    return [int(rng.paretovariate(0.6)) % 90 for _ in range(n)]


@pytest.mark.parametrize("most, drop", [(1, 1), (7, 1), (20, 1), (20, 3), (22, 22), (40, 5), (200, 21)])
def test_distances(most, drop):
    rng = random.Random(most)
    for shape in ("hot", "drifting", "round", "rare"):
        keys = draws(rng, 900, shape)
        recency, order = caps.Recency(most), []
        for k in keys:
            want = order[::-1].index(k) if k in order else most
            got = recency.seen(k, most - drop + 1)
            assert got == (min(want, most) if min(want, most) > most - drop else 0)
            order = [*(o for o in order if o != k), k]


@pytest.mark.parametrize("most, drop", [(1, 1), (7, 1), (20, 3), (22, 22), (40, 5)])
@pytest.mark.parametrize("shape", ["hot", "drifting", "round", "rare"])
def test_marked(spark, shape, most, drop):
    """Many small ranges, so that much crosses from one to others."""
    keys = draws(random.Random(7), 700, shape)
    want = plain(keys, most, drop)
    known, forgotten = set(), set()
    for i, (k, new) in enumerate(zip(keys, want, strict=True)):
        if new and k in known:
            forgotten.add(i)
        known.add(k)
    df = spark.createDataFrame([(f"k{k}", i, "x") for i, k in enumerate(keys)], "k string, at long, `a.b` string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = caps.marked(df, ["k"], ["at"], most, drop).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    firsts = {keys.index(k) for k in known}
    assert len(got) == len(keys) and all(r["a.b"] == "x" for r in got)
    # a key's first row may say either: there is nothing to forget
    assert {r["at"] for r in got if r["fresh"]} - firsts == forgotten


def test_marked_odd(spark):
    rows = [(None, 1), (None, 2), ("a", 2), ("b", 2), (None, 3), (None, None)]
    df = spark.createDataFrame(rows, "k string, at long")
    got = sorted((r["at"] or 0, r["k"] or "", r["fresh"]) for r in caps.marked(df, ["k"], ["at"], 2).collect())
    assert [(a, k) for a, k, f in got if f and (a, k) != (0, "")] == [(2, "a"), (2, "b"), (3, "")]
    assert caps.marked(df.limit(0), ["k"], ["at"], 2).count() == 0
    assert not any(r["fresh"] for r in caps.marked(df, ["k"], ["at"], 0).collect())
    with pytest.raises(ValueError):
        caps.marked(df, ["k"], ["at"], 2, 3)


def test_series_limit(spark):
    """A series that others have pushed out learns from the start."""
    seen = ["a", "b", "a", "c", "a", "b", "d", "a", "c"]
    df = spark.createDataFrame([(s, "value", i, i, float(i)) for i, s in enumerate(seen)], "series string, metric string, event_id long, t long, value double").selectExpr(
        "series", "metric", "event_id", "timestamp_seconds(t) AS ts", "value"
    )
    config = metric_detector.MetricConfig(max_series=2)
    got = {r["event_id"]: r["n"] for r in metric_detector.judge(df, config).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0}
    first, second, folders = df.filter("event_id < 4"), df.filter("event_id >= 4"), [new_path(spark) for _ in range(2)]
    parts = [metric_detector.judge(first, config, resume=Resume(folders[0])), metric_detector.judge(second, config, resume=Resume(folders[1], folders[0]))]
    assert {r["event_id"]: r["n"] for p in parts for r in p.collect()} == got


def test_pattern_limit(spark):
    """A pattern that was forgotten is told again within its cooldown."""
    rng = random.Random(3)
    patterns = [rng.randrange(45) for _ in range(600)]
    df = spark.createDataFrame([("k", "s", str(p), i, i, 0.5) for i, p in enumerate(patterns)], "kind string, source string, pattern string, seq long, t long, score double").selectExpr(
        "kind", "source", "pattern", "seq", "timestamp_seconds(t) AS ts", "score"
    )
    got = {r["seq"] for r in dampening.dampen(df, dampening.DampenConfig(max_tracked=30)).filter("reported").collect()}
    assert got == {i for i, new in enumerate(plain(patterns, 30, 4)) if new}
