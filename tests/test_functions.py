"""Decision tables of the column functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.config import duration, load
from tidemark.functions import series, templates, text


def table(spark, values, kind, *columns):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.select(*[c(F.col("v")) for c in columns]).collect()]


def test_levels(spark):
    given = ["WARN", "notice", "crit", "nope", "0", "-3", "3", "4", "6", "7", "8", None, "panic"]
    want = ["warn", "info", "fatal", None, "fatal", "fatal", "error", "warn", "info", "debug", None, None, "fatal"]
    assert table(spark, given, "string", text.level_of) == want


def test_times(spark):
    given = ["2026-03-05T08:11:30Z", "2026-03-05T10:11:30+02:00", "2026-03-05 08:11:30", "2026-03-05T08:11:30+0000", "1772698290", "1772698290000", "1772698290000000", "2026", "12", None]
    got = table(spark, given, "string", lambda v: F.date_format(text.time_of(v), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2026-03-05 08:11:30"] * 7 + [None] * 3


def test_parse_lines(spark):
    none = (None, None, None, None)
    cases = [
        ('{"time":"2026-03-05T08:11:30Z","level":"ERROR","msg":"timeout"}', ("timeout", "error", datetime(2026, 3, 5, 8, 11, 30), None)),
        ('\x1b[36m2026-03-06T17:05:09.250731846Z app[web.1]:\x1b[0m {"level":"warn","ts":1772816709.5,"msg":"skipped"}', ("skipped", "warn", datetime(2026, 3, 6, 17, 5, 9, 250731), "app[web.1]")),
        ("2026-03-06T17:05:09Z app[web.1]: PUT /orders/7", ("PUT /orders/7", None, datetime(2026, 3, 6, 17, 5, 9), "app[web.1]")),
        ("\x1b[0;33msome warning\x1b[0m", ("some warning", None, None, None)),
        ("router[x]: at=info", ("at=info", None, None, "router[x]")),
        ('{"msg":"x","level":3}', ("x", "error", None, None)),
        ('{"msg":"x","severity":"7"}', ("x", "debug", None, None)),
        ('{"msg":5,"message":""}', none),
        ('{"MESSAGE":"x"}', none),
        ("{broken json", none),
        ("plain", none),
    ]
    rows = [(k, raw, None, None, None) for k, (raw, _) in enumerate(cases)]
    rows += [(100, '{"msg":"outer"}', '{"msg":"outer"}', "NOTICE", None), (101, "raw", "given", "verbose", None)]
    df = spark.createDataFrame(rows, "k int, raw string, message string, level string, timestamp timestamp")
    got = {r["k"]: (r["message"], r["level"], r["timestamp"], r["log_process"]) for r in text.parse_lines(df).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k][:2] == want[:2] and got[k][3] == want[3], k
        assert (got[k][2] is None) == (want[2] is None), k
    assert got[100][:2] == ('{"msg":"outer"}', "info") and got[101][:2] == ("given", "verbose")


def test_cut_bytes(spark):
    given = ["abc", "é" * 5, "漢" * 4, "\U0001f600" * 3, "aé"]
    assert table(spark, given, "string", lambda v: text.cut_bytes(v, 8)) == ["abc", "é" * 4, "漢" * 2, "\U0001f600" * 2, "aé"]
    assert table(spark, ["aé", "a漢", "a\U0001f600b"], "string", lambda v: text.cut_bytes(v, 2)) == ["a", "a", "a"]


def test_prometheus(spark):
    lines = {
        "": None, "# HELP x": None, "cache_hits_total 512": ("cache_hits_total", 512.0, {}, None),
        "cache_hits_total 512 1772698290000": ("cache_hits_total", 512.0, {}, 1772698290000),
        'r{method="post",code="200"} 1e3': ("r", 1000.0, {"method": "post", "code": "200"}, None),
        r'a{path="C:\\DIR\\new",error="Cannot find \"file\"\n"} 1.458e+09': ("a", 1.458e9, {"path": "C:\\DIR\\new", "error": 'Cannot find "file"\n'}, None),
        "no_value": None, 'broken{label="unterminated} 1': None, "x abc": None, "x 1 2 3": None, "1bad:name 2": ("1bad:name", 2.0, {}, None), "a.b 1": None, "x +Inf": ("x", float("inf"), {}, None),
    }
    got = table(spark, list(lines), "string", series.prometheus_sample)
    for (line, want), s in zip(lines.items(), got, strict=True):
        assert (s is None) == (want is None), line
        if want:
            assert (s["name"], s["value"], s["labels"]) == want[:3], line
            assert (s["timestamp"] is None) == (want[3] is None)


def test_humanized(spark):
    given = {0.0: "0s", 0.3: "0.3s", 6.0: "6s", 9.5: "9.5s", 45.0: "45s", 60.0: "1m", 63.0: "1m 3s", 1667.7: "27m 48s", 6002.0: "1h 40m", 7200.0: "2h", 86400.0: "1d", 90000.0: "1d 1h", 68788.0: "19h 6m", -180.0: "-3m", 0.04: "<0.1s", 3599.6: "1h", 9.96: "10s"}
    assert table(spark, list(given), "double", series.humanized) == list(given.values())
    assert table(spark, [20.0, -180.0, 0.0], "double", series.signed) == ["+20s", "-3m", "+0s"]


GLOBS = [
    ("Lease of <IP> ends in *", "Lease of <IP> ends in <NUM> days (pool a)", True), ("Lease*", "Release", False),
    ("Queue <*> drained by <*> worker*", "Queue <*> drained by <*> worker <*> <NUM>", True), ("Queue <*> drained by <*> worker*", "Queue drained by worker", False),
    ("*(pool a)", "Renewed <*> (pool a)", True), ("(cart) ADD*", "(cart) ADD ( 2 x / y && z)", True), ("", "", True), ("", "anything", False), ("*", "anything", True), ("a*b*c", "azzbzzc", True), ("a*b*c", "azzbzz", False),
]


@pytest.mark.parametrize("pattern, value, want", GLOBS)
def test_text_glob(spark, pattern, value, want):
    assert table(spark, [value], "string", lambda v: templates.text_glob(v, pattern)) == [want]


def test_path_glob(spark):
    values = ["disk_percent", "a/b", "a1", "ab"]
    assert table(spark, values, "string", lambda v: templates.path_glob(v, "*percent")) == [True, False, False, False]
    assert table(spark, values, "string", lambda v: templates.path_glob(v, "a?")) == [False, False, True, True]
    assert table(spark, values, "string", lambda v: templates.path_glob(v, "a[0-9]")) == [False, False, True, False]


def test_templates(spark):
    assert table(spark, ["é42 from 10.0.0.1 a@b.io deadbeef01"], "string", templates.mask) == ["é<NUM> from <IP> <EMAIL> <HEX>"]
    words = " ".join(map(str, range(40)))
    assert table(spark, [words], "string", lambda v: F.array_join(templates.tokens(v), " ")) == [" ".join([*map(str, range(31)), "<TRUNCATED>"])]
    assert table(spark, ["a <NUM> <*> bcd", "<IP>", ""], "string", templates.literals, lambda v: F.round(templates.placeholder_ratio(v), 3)) == [(4, 0.5), (0, 1.0), (0, 0.0)]
    got = table(spark, ["x"], "string", lambda v: templates.parameters(F.split(F.lit("a <*> <IP> b<NUM>s"), " "), F.split(F.lit("a q 1 b2s"), " ")))
    assert got == [["q", "1"]]


def test_series_key(spark):
    labels = F.create_map(F.lit("z"), F.lit("/"), F.lit("a"), F.lit("1"))
    key = table(spark, ["prod/api"], "string", lambda v: series.series_key(v, F.lit("disk"), labels))[0]
    assert key == "prod/api/disk{a=1}{z=/}"
    assert table(spark, [key, "p/s/m"], "string", series.metric_name) == ["disk", "m"]
    assert table(spark, ["cpu_percent", "load"], "string", series.min_delta) == [10.0, 0.0]


def test_config():
    c = load("logs:\n  detection:\n    learning_period: 1m30s\nmetrics:\n  detection:\n    thresholds:\n      - metric: ${M}\n        max: 90\n", {"M": "pool"})
    assert c.logs.detection.learning_period == 90 and c.metrics.detection.thresholds[0].metric == "pool" and c.dampening.cooldown == 3600
    assert duration("168h") == 604_800 and duration("-1.5s") == -1.5
    for bad in ("nope: 1", "logs:\n  drain:\n    depth: 2", "correlation:\n  clock: sun", "logs:\n  detection:\n    learning_period: soon", "metrics:\n  detection:\n    warmup_samples: -1"):
        with pytest.raises(ValueError):
            load(bad)
