"""Registered queries over the given tables, with the SQL that checks them.

Events serve as metric samples (a series a user), as log lines (a source a user, template ``<type> <k mod 3>``),
signups as changes and errors as signals of a user; texts' lines serve as log lines.  Keys grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import series, templates, text
from tidemark.operators import caps, correlate, dampening, incidents, log_detector, metric_detector, mining, readapi, state
from tidemark.operators.folds import Resume
from tidemark.shared import new_path
from tidemark.sources import documents, event_log, lines
from tidemark.streaming import correlation
from tidemark.streaming.folds import PROVIDER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("source", F.concat(F.lit("prod/"), F.col("user_id").cast("string")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "ts", "value", F.lit("value").alias("metric"), F.concat("source", F.lit("/value")).alias("series"))


def k_of(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("bigint")


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as matched log lines of their user."""
    name = F.concat_ws(" ", "event_type", (k_of() % 3).cast("string"))
    return events(spark, sf_dir).select("source", F.col("event_id").alias("seq"), "ts", name.alias("template_id"), name.alias("template"))


def user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as signals of their users."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    kind = F.when(F.col("value") > 60, "log.rare_template").otherwise("metric.zscore")
    return e.select(
        F.concat(F.lit("user/"), "user_id").alias("source"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"),
        F.split(kind, r"\.")[0].alias("modality"), F.least(F.lit(0.95), 0.3 + F.col("value") / 100).alias("score"),
        F.concat_ws("/", kind, (k_of() % 3).cast("string")).alias("merge_key"),
    )


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return e.select(F.concat(F.lit("user/"), "user_id").alias("source"), F.col("event_id").alias("change_id"), "ts")


# ---- lines and fields


@query("""SELECT event_id, 'prod/' || event_type AS source, 'prod' AS environment, event_type AS service, 'metric' AS modality, ts AS timestamp,
  CAST(NULL AS VARCHAR) AS rejected FROM events""")
def obs_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    none = lambda kind: F.lit(None).cast(kind)
    rows = e.select(
        "event_id", none("string").alias("id"), none("string").alias("source"), F.col("event_type").alias("service"), F.lit("prod").alias("environment"),
        F.lit("metric").alias("modality"), F.col("ts").alias("timestamp"), F.col("ts").alias("ingested_at"),
        none("struct<raw: string, message: string>").alias("log"), F.struct(F.lit("value").alias("name"), "value").alias("metric"), none("struct<type: string>").alias("change"),
    )
    return text.normalize(rows).select("event_id", "source", "environment", "service", "modality", "timestamp", "rejected")


@query("""SELECT event_id, 'k is ' || json_extract_string(props, '$.k') AS message, 'error' AS level, ts AS timestamp FROM events""")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    raw = F.to_json(F.struct(F.concat(F.lit("k is "), k_of().cast("string")).alias("msg"), F.lit(3).alias("severity"), micros.alias("ts")))
    lines = e.select("event_id", raw.alias("raw"), *[F.lit(None).cast(k).alias(n) for n, k in (("message", "string"), ("level", "string"), ("timestamp", "timestamp"))])
    return text.parse_lines(lines).select("event_id", "message", "level", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")


_LINES = """SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(ls[i]) <> ''"""


@query(f"WITH l AS ({_LINES}) SELECT doc_id, line_no, length(line) AS n_chars, md5(line) AS line_md5 FROM l")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.length("line").cast("long").alias("n_chars"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


def _mask_sql(column: str) -> str:
    for name, pattern in templates.MASKS:
        column = f"regexp_replace({column}, '{pattern}', '<{name}>', 'g')"
    return column


@query(f"WITH l AS ({_LINES}) SELECT doc_id, line_no, {_mask_sql('line')} AS masked FROM l")
def mask_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", templates.mask(F.col("line")).alias("masked"))


_TOKENS = r"""list_filter(string_split_regex(masked, '\s+'), lambda x: x <> '')"""


@query(f"""WITH l AS ({_LINES}), m AS (SELECT doc_id, line_no, {_mask_sql('line')} AS masked FROM l), t AS (SELECT doc_id, line_no, {_TOKENS} AS ws FROM m)
  SELECT doc_id, line_no, CAST(len(ws) AS INTEGER) AS n_words, array_to_string(CASE WHEN len(ws) > 32 THEN list_append(ws[1:31], '<TRUNCATED>') ELSE ws END, ' ') AS tokens FROM t""")
def tokenize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _lines(spark, sf_dir).withColumn("masked", templates.mask(F.col("line")))
    return m.select("doc_id", "line_no", F.size(templates.tokens(F.col("masked"), 0)).alias("n_words"), F.array_join(templates.tokens(F.col("masked")), " ").alias("tokens"))


@query(f"""WITH l AS ({_LINES}), m AS (SELECT DISTINCT {_mask_sql('line')} AS masked FROM l), t AS (SELECT masked, {_TOKENS} AS ws FROM m)
  , f AS (SELECT masked, CAST(length(regexp_replace(regexp_replace(masked, '<[^>]{{0,7}}>', '', 'g'), '[^A-Za-z0-9]', '', 'g')) AS INTEGER) AS literals,
    round(len(list_filter(ws, lambda x: regexp_full_match(x, '<[^<>]+>'))) / CAST(len(ws) AS DOUBLE), 9) AS ratio FROM t)
  SELECT md5(masked) AS template_md5, literals, ratio, literals >= 8 AND ratio <= 0.6 AS informative FROM f""")
def informative_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _lines(spark, sf_dir).select(templates.mask(F.col("line")).alias("masked")).distinct()
    t = F.col("masked")
    return m.select(
        F.md5(t.cast("binary")).alias("template_md5"), templates.literals(t).alias("literals"),
        F.round(templates.placeholder_ratio(t), 9).alias("ratio"), templates.informative(t).alias("informative"),
    )


@query("""SELECT 'prod/' || event_type || '/value{k=' || json_extract_string(props, '$.k') || '}{user=' || user_id || '}' AS series, 'value' AS metric, count(*) AS n
  FROM events GROUP BY ALL""")
def series_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), k_of().cast("string"))
    e = table(spark, sf_dir, "events").select(series.series_key(F.concat(F.lit("prod/"), "event_type"), F.lit("value"), labels).alias("series"))
    return e.groupBy("series", series.metric_name(F.col("series")).alias("metric")).agg(F.count("*").alias("n"))


MARKINGS = {"error 3": "symptomatic"}
PATTERNS = {"error*": "ignore", "err*": "normal", "view 1*": "heartbeat", "*7": "normal"}


@query("""WITH t AS (SELECT event_type || ' ' || json_extract_string(props, '$.k') AS template, count(*) AS n FROM events GROUP BY 1),
  p(pattern, marking) AS (VALUES ('error*', 'ignore'), ('err*', 'normal'), ('view 1*', 'heartbeat'), ('*7', 'normal'))
  SELECT template, n, CASE WHEN template = 'error 3' THEN 'symptomatic' ELSE
    (SELECT arg_min(marking, (-length(pattern), pattern)) FROM p WHERE template GLOB pattern) END AS marking FROM t""")
def marking_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy(F.concat_ws(" ", "event_type", k_of().cast("string")).alias("template")).agg(F.count("*").alias("n"))
    return t.withColumn("marking", templates.best_marking(F.col("template"), MARKINGS, PATTERNS))


@query("""SELECT level, CASE WHEN TRY_CAST(level AS BIGINT) IS NOT NULL THEN
    CASE WHEN CAST(level AS BIGINT) <= 2 THEN 'fatal' WHEN CAST(level AS BIGINT) = 3 THEN 'error' WHEN CAST(level AS BIGINT) = 4 THEN 'warn'
      WHEN CAST(level AS BIGINT) <= 6 THEN 'info' WHEN CAST(level AS BIGINT) = 7 THEN 'debug' END
    ELSE CASE lower(level) WHEN 'error' THEN 'error' END END AS normalized, n
  FROM (SELECT unnest([event_type, CAST(json_extract(props, '$.k') AS VARCHAR), upper(event_type)]) AS level, count(*) AS n FROM events GROUP BY 1)""")
def level_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    levels = e.select(F.explode(F.array("event_type", k_of().cast("string"), F.upper("event_type"))).alias("level"))
    return levels.groupBy("level").agg(F.count("*").alias("n")).select("level", text.level_of(F.col("level")).alias("normalized"), "n")


@query("""SELECT event_id, 'event_value' AS name, event_type AS type_label, 'a"b\\\\c' || chr(10) || user_id AS user_label, value, ts FROM events""")
def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as exposition lines and parsed again."""
    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit('a\\"b\\\\\\\\c\\n'), F.col("user_id").cast("string"))
    millis = F.unix_millis(F.date_trunc("second", F.col("ts").cast("timestamp")))
    line = F.concat(F.lit('event_value{type="'), "event_type", F.lit('", user="'), user, F.lit('"} '), F.col("value").cast("string"), F.lit(" "), millis.cast("string"))
    s = e.select("event_id", F.col("ts").alias("own"), series.prometheus_sample(line).alias("s"))
    exact = F.when(F.date_trunc("second", F.col("own").cast("timestamp")) == F.col("s.timestamp"), F.col("own"))
    return s.select("event_id", "s.name", F.col("s.labels")["type"].alias("type_label"), F.col("s.labels")["user"].alias("user_label"), "s.value", exact.alias("ts"))


# ---- metric detector

_EWMA = """WITH RECURSIVE s AS (
  SELECT 'prod/' || user_id || '/value' AS series, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
), f AS (
  SELECT series, rn, event_id, ts, value, 0 AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS variance, 0.0::DOUBLE AS fast, 0.0::DOUBLE AS slow,
    1 AS n2, value AS mean2, 0.0::DOUBLE AS variance2, value AS fast2, value AS slow2 FROM s WHERE rn = 1
  UNION ALL
  SELECT s.series, s.rn, s.event_id, s.ts, s.value, f.n2, f.mean2, f.variance2, f.fast2, f.slow2, f.n2 + 1,
    f.mean2 + 0.05::DOUBLE * (s.value - f.mean2),
    (1 - 0.05::DOUBLE) * (f.variance2 + 0.05::DOUBLE * (s.value - f.mean2) * (s.value - f.mean2)),
    f.fast2 + 0.3::DOUBLE * (s.value - f.fast2), f.slow2 + 0.05::DOUBLE * (s.value - f.slow2)
  FROM f JOIN s ON s.series = f.series AND s.rn = f.rn + 1
)"""


@query(f"""{_EWMA}, z AS (SELECT *, (value - mean) / sqrt(variance) AS z FROM f WHERE n >= 30 AND variance > 0)
  SELECT series, event_id, ts, value, round(mean, 6) AS mean, round(z, 6) AS z, round(least(0.95, 0.5 + abs(z) / 10), 6) AS score FROM z WHERE abs(z) >= 3""")
def metric_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zscores(metric_detector.judge(samples(spark, sf_dir), metric_detector.MetricConfig(daily=False)))


def zscores(judged: DataFrame) -> DataFrame:
    found = metric_detector.signals(judged).filter(F.col("kind") == metric_detector.ZSCORE)
    return found.select(
        "series", "event_id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "value", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"), F.round("score", 6).alias("score")
    )


@query(SQL["metric_zscore"])
def resumed_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the events before and after the middle of their time, the second going on with what the first has learned."""
    e = samples(spark, sf_dir)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = e.agg(F.avg(us)).first()[0] or 0  # one number
    first, second = new_path(spark), new_path(spark)
    config = metric_detector.MetricConfig(daily=False)
    runs = [metric_detector.judge(e.filter(us < middle), config, resume=Resume(first)), metric_detector.judge(e.filter(us >= middle), config, resume=Resume(second, first))]
    return zscores(runs[0].union(runs[1]))


@query(f"""{_EWMA}, last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY rn DESC) = 1)
  SELECT series, CAST(n2 AS BIGINT) AS samples, round(mean2, 6) AS mean, round(sqrt(variance2), 6) AS std_dev, round(fast2, 6) AS recent, n2 < 30 AS warmup FROM last""")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metric_detector.series_table(samples(spark, sf_dir))
    return t.select("series", "samples", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"), F.round("recent", 6).alias("recent"), "warmup")


@query(f"""{_EWMA}, d AS (SELECT *, abs(fast - slow) / greatest(abs(slow), 1e-9) >= 0.5 AS drifts FROM f WHERE n >= 30)
  SELECT series, event_id, value FROM (SELECT *, coalesce(lag(drifts) OVER (PARTITION BY series ORDER BY rn), false) AS before FROM d) WHERE drifts AND NOT before""")
def metric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = metric_detector.judge(samples(spark, sf_dir), metric_detector.MetricConfig(daily=False))
    return metric_detector.signals(judged).filter(F.col("kind") == metric_detector.DRIFT).select("series", "event_id", "value")


@query("""SELECT 'prod/' || user_id || '/value' AS series, event_id, value, 0.9 ::DOUBLE AS score FROM events WHERE value > 150 UNION ALL
  SELECT 'prod/' || user_id || '/value', event_id, value, 0.9 FROM events WHERE value < 0.5""")
def metric_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = metric_detector.judge(samples(spark, sf_dir), metric_detector.MetricConfig(warmup=1 << 30), {"value": (150.0, 0.5)})
    return metric_detector.signals(judged).filter(F.col("kind") == metric_detector.THRESHOLD).select("series", "event_id", "value", "score")


_DEVIATIONS = f"""{_EWMA}, z AS (SELECT series, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY series ORDER BY rn) AS k FROM f
    WHERE n >= 30 AND variance > 0 AND abs((value - mean) / sqrt(variance)) >= 2),
  d AS (
    SELECT series, k, event_id, us, 0 AS days, [us] AS seen FROM z WHERE k = 1
    UNION ALL
    SELECT z.series, z.k, z.event_id, z.us, CASE WHEN len(list_filter(seen, lambda x: abs(x - (z.us - 86400000000)) <= 21600000000)) = 0 THEN 0
        WHEN len(list_filter(seen, lambda x: abs(x - (z.us - 172800000000)) <= 21600000000)) = 0 THEN 1 ELSE 2 END,
      CASE WHEN abs(z.us - seen[-1]) > 21600000000 THEN list_append(seen, z.us)[-32:] ELSE seen END
    FROM d JOIN z ON z.series = d.series AND z.k = d.k + 1)"""


@query(f"{_DEVIATIONS} SELECT series, event_id, CAST(days AS INTEGER) AS days, days < 2 AS told FROM d")
def metric_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations, and on how many days in a row before one came at about that time; the third day's isn't told."""
    config = metric_detector.MetricConfig(z_threshold=2.0, trend=1e18, tolerance_us=6 * 3_600_000_000)
    judged = metric_detector.judge(samples(spark, sf_dir), config).filter(F.abs("z") >= 2)
    return judged.select("series", "event_id", F.col("recurring_days").alias("days"), (F.size("kinds") > 0).alias("told"))


@query("""SELECT 'prod/' || user_id || '/value' AS series, event_id FROM events WHERE value > 150 AND user_id % 10 <> 7 AND user_id NOT IN (3, 5)""")
def metric_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits passed by series that no glob of ignored ones fits."""
    config, ignored = metric_detector.MetricConfig(warmup=1 << 30), ["prod/*7/value", "prod/[35]/value"]
    judged = metric_detector.judge(samples(spark, sf_dir), config, {"value": (150.0, None)}, ignored)
    return metric_detector.signals(judged).select("series", "event_id")


@query("""WITH d AS (SELECT event_type, event_id, ts FROM events WHERE value > 150)
  SELECT a.event_type, a.event_id, CAST(CASE WHEN NOT bool_or(coalesce(b.ts BETWEEN a.ts - INTERVAL 25 HOUR AND a.ts - INTERVAL 23 HOUR, false)) THEN 0
    WHEN NOT bool_or(coalesce(b.ts BETWEEN a.ts - INTERVAL 49 HOUR AND a.ts - INTERVAL 47 HOUR, false)) THEN 1 ELSE 2 END AS INTEGER) AS days
  FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND b.ts < a.ts GROUP BY 1, 2""")
def metric_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in a row before a high value with another at that hour, by meeting on hours."""
    d = table(spark, sf_dir, "events").filter("value > 150").select("event_type", "event_id", correlate.seconds(F.col("ts")).alias("s"))
    seen = d.select(F.col("event_type").alias("t"), F.col("s").alias("bs"), F.floor(F.col("s") / 3600).alias("slot"))

    def day(n: int) -> DataFrame:
        at = F.col("s") - 86400 * n
        mine = d.withColumn("slot", F.explode(F.sequence(F.floor((at - 3600) / 3600), F.floor((at + 3600) / 3600))))
        near = mine.join(seen, (F.col("event_type") == F.col("t")) & (mine["slot"] == seen["slot"]) & F.col("bs").between(at - 3600, at + 3600), "left_semi")
        return near.select("event_id", F.lit(n).alias("n")).distinct()

    found = day(1).union(day(2)).groupBy("event_id").agg(F.sum("n").alias("which"))
    days = F.when(F.col("which") == 3, 2).when(F.col("which") == 1, 1).otherwise(0)
    return d.join(found, "event_id", "left").select("event_type", "event_id", days.alias("days"))


@query("""SELECT event_type, k, n, value FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(max(value), 6) AS value FROM events GROUP BY 1, 2)
  WHERE value >= CASE WHEN event_type LIKE '%up' THEN 100 WHEN event_type = 'error' THEN 150 ELSE 0 END""")
def metric_min_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type", k_of().alias("k")).agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("value"))
    return g.filter(F.col("value") >= series.min_delta(F.col("event_type"), {"*up": 100.0, "error": 150.0}))


@query("""SELECT user_id, event_id, round(value - lag(value) OVER w, 6) AS delta, round(100 * (value - lag(value) OVER w) / (epoch_us(ts) - lag(epoch_us(ts)) OVER w) * 1e6, 6) AS rate
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(ts) OVER w IS NOT NULL""")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of a counter against time, from each sample to the next of its host."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumns({"delta": F.col("value") - F.lag("value").over(w), "passed": F.col("us") - F.lag("us").over(w)}).filter("passed is not null")
    return e.select("user_id", "event_id", F.round("delta", 6).alias("delta"), F.round(100 * F.col("delta") / F.col("passed") * 1e6, 6).alias("rate"))


# ---- log detector


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2""")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2""")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))


_TEMPLATE = "event_type || ' ' || (CAST(json_extract(props, '$.k') AS BIGINT) % 3)"


def _detected(spark: SparkSession, sf_dir: str, config: log_detector.LogConfig, **how) -> DataFrame:
    """Signals of the log detector over events as matched lines, all of which say enough."""
    change = F.when(F.row_number().over(Window.partitionBy("source", "template").orderBy("ts", "seq")) == 1, mining.CREATED).otherwise(mining.SAME)
    found = log_detector.detect(log_rows(spark, sf_dir).withColumn("change_type", change), config, min_literals=0, max_ratio=1.0, **how)
    return found.withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz"))


@query(f"""WITH t AS (SELECT user_id, {_TEMPLATE} AS template, ts, event_id FROM events), s AS (SELECT user_id, min(ts) AS start FROM events GROUP BY 1)
  SELECT 'prod/' || user_id AS source, template, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, template ORDER BY ts, event_id) AS n FROM t) JOIN s USING (user_id)
  WHERE n = 1 AND ts >= start + INTERVAL 5 MINUTE""")
def new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences after the learning period of their source."""
    found = _detected(spark, sf_dir, log_detector.LogConfig()).filter(F.col("kind") == log_detector.NEW)
    return found.select("source", "template", F.col("seq").alias("event_id"), "ts")


@query(f"""SELECT source, event_id, template FROM (SELECT 'prod/' || user_id AS source, event_id, {_TEMPLATE} AS template, row_number() OVER (PARTITION BY user_id, {_TEMPLATE} ORDER BY ts, event_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM events) WHERE n BETWEEN 2 AND 3 AND total >= 30""")
def rare_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and third occurrences once their source has 30 rows."""
    config = log_detector.LogConfig(learning_us=0, rare_total=30, rare_interval_s=0)
    return _detected(spark, sf_dir, config).filter(F.col("kind") == log_detector.RARE).select("source", F.col("seq").alias("event_id"), "template")


@query(f"""SELECT 'prod/' || user_id AS source, event_id, template, score FROM (SELECT user_id, event_id, {_TEMPLATE} AS template, 0.9::DOUBLE AS score FROM events) WHERE template LIKE 'error %'""")
def symptomatic_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of templates that a glob marks as symptoms."""
    found = _detected(spark, sf_dir, log_detector.LogConfig(), patterns={"error *": "symptomatic"}).filter(F.col("kind") == log_detector.SYMPTOM)
    return found.select("source", F.col("seq").alias("event_id"), "template", "score")


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, {_TEMPLATE} AS template, epoch_us(ts) // 86400000000 AS day, row_number() OVER (PARTITION BY user_id, {_TEMPLATE}, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS i FROM events),
  b AS (SELECT user_id, template, day, max(i) AS n, row_number() OVER (PARTITION BY user_id, template ORDER BY day) AS k FROM r GROUP BY 1, 2, 3),
  f AS (SELECT user_id, template, day, n, k, 0.0::DOUBLE AS usual FROM b WHERE k = 1 UNION ALL
    SELECT b.user_id, b.template, b.day, b.n, b.k, list_reduce(list_prepend(f.usual + 0.3::DOUBLE * (f.n - f.usual), list_transform(range(least(b.day - f.day - 1, 60)), lambda x: 0.7::DOUBLE)), lambda x, y: x * y)
    FROM f JOIN b ON b.user_id = f.user_id AND b.template = f.template AND b.k = f.k + 1)
  SELECT 'prod/' || user_id AS source, arg_min(event_id, i) AS event_id, template FROM r JOIN f USING (user_id, template, day) WHERE usual > 0 AND i >= greatest(3, 2 * usual) GROUP BY user_id, template, day""")
def burst_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with which a template comes twice as often a day as usual, and three times at least."""
    config = log_detector.LogConfig(learning_us=0, bucket_us=24 * log_detector.HOUR, spike_count=3, spike_factor=2.0, hourly=False)
    return _detected(spark, sf_dir, config).filter(F.col("kind") == log_detector.SPIKE).select("source", F.col("seq").alias("event_id"), "template")


@query("""SELECT user_id, event_id, gap_s FROM (SELECT user_id, event_id, epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6 AS gap_s FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap_s > 86400""".replace("epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6", "(epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6"))
def silent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", ((F.lead(us).over(w) - us) / 1e6).alias("gap_s")).filter("gap_s > 86400")


@query()
def log_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of the log detector over events as log lines."""
    rows = log_rows(spark, sf_dir)
    change = F.when(F.row_number().over(Window.partitionBy("source", "template").orderBy("ts", "seq")) == 1, mining.CREATED).otherwise(mining.SAME)
    config = log_detector.LogConfig(rare_total=30, rare_interval_s=0, bucket_us=24 * log_detector.HOUR, spike_count=3, spike_factor=2, missing_count=5, max_cv=2)
    found = log_detector.detect(rows.withColumn("change_type", change), config, markings={"error 1": "symptomatic"}, patterns={"view*": "heartbeat"}, min_literals=4)
    return found.select("source", "seq", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "kind", "score", "template", "marking")


@query()
def drain_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates mined from the lines of all documents, one miner a source."""
    return mining.mined_templates(_lines(spark, sf_dir).withColumnRenamed("line", "message"), ["doc_id", "line_no"])


# ---- dampening and correlation


_SIGNALS = """SELECT 'user/' || user_id AS source, event_id AS seq, ts, CASE WHEN value > 60 THEN 'log.rare_template' ELSE 'metric.zscore' END AS kind,
  CASE WHEN value > 60 THEN 'log' ELSE 'metric' END AS modality, least(0.95, 0.3 + value / 100) AS score,
  CASE WHEN value > 60 THEN 'log.rare_template' ELSE 'metric.zscore' END || '/' || (CAST(json_extract(props, '$.k') AS BIGINT) % 3) AS merge_key
  FROM events WHERE event_type = 'error'"""


@query(f"""WITH RECURSIVE s AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY kind, source, merge_key ORDER BY ts, seq) AS rn FROM ({_SIGNALS})),
  f AS (
    SELECT kind, source, merge_key, rn, seq, score, us AS reported_at, us AS last_seen, score AS top, 0 AS streak, CAST(0 AS BIGINT) AS held,
      true AS reported, CAST(0 AS BIGINT) AS suppressed, CAST(NULL AS DOUBLE) AS escalated_from FROM s WHERE rn = 1
    UNION ALL
    SELECT kind, source, merge_key, rn, seq, score, CASE WHEN reported THEN us ELSE reported_at END, us, CASE WHEN reported THEN score ELSE top END,
      CASE WHEN escalates THEN 0 WHEN quiet AND NOT back THEN streak1 + 1 ELSE streak1 END, CASE WHEN reported THEN 0 ELSE held + 1 END,
      reported, CASE WHEN reported THEN held ELSE 0 END, CASE WHEN escalates THEN top END
    FROM (SELECT *, escalates OR quiet AS reported FROM (SELECT *, us - reported_at >= least(43200000000, 3600000000 * (CAST(1 AS BIGINT) << streak1)) AS quiet
      FROM (SELECT *, CASE WHEN back THEN 0 ELSE streak END AS streak1
        FROM (SELECT s.kind, s.source, s.merge_key, s.rn, s.seq, s.score, s.us, f.reported_at, f.top, f.streak, f.held, s.score >= f.top + 0.1::DOUBLE AS escalates,
            s.us - f.last_seen > least(43200000000, 3600000000 * (CAST(1 AS BIGINT) << f.streak)) AS back
          FROM f JOIN s ON s.kind = f.kind AND s.source = f.source AND s.merge_key = f.merge_key AND s.rn = f.rn + 1))))
  )
  SELECT kind, source, merge_key AS pattern, seq, round(score, 6) AS score, suppressed, streak AS repeats, round(escalated_from, 6) AS escalated_from FROM f WHERE reported""")
def dampen_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = user_signals(spark, sf_dir).withColumn("pattern", F.col("merge_key"))
    found = dampening.dampen(s)
    return found.filter("reported").select("kind", "source", "pattern", "seq", F.round("score", 6).alias("score"), "suppressed", "repeats", F.round("escalated_from", 6).alias("escalated_from"))


@query(f"""WITH s AS ({_SIGNALS}) SELECT source, time_bucket(INTERVAL 1 DAY, ts) AS day, merge_key, arg_min(seq, (-score, ts, seq)) AS seq, round(max(score), 6) AS score, count(*) AS occurrences
  FROM s GROUP BY 1, 2, 3""")
def merge_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = user_signals(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return correlate.merge_signals(s, ["source", "day"]).select("source", "day", "merge_key", "seq", F.round("score", 6).alias("score"), "occurrences")


@query(f"""WITH s AS ({_SIGNALS}), m AS (SELECT source, time_bucket(INTERVAL 1 DAY, ts) AS day, merge_key, max(score) AS score, any_value(modality) AS modality FROM s GROUP BY 1, 2, 3),
  c AS (SELECT source, day, least(0.99, 1 - exp(sum(ln(1 - least(score, 0.99))))) AS confidence, bool_or(modality = 'log') AND bool_or(modality = 'metric') AS multimodal, count(*) AS n FROM m GROUP BY 1, 2)
  SELECT source, day, round(confidence, 6) AS confidence, multimodal, CASE WHEN confidence < 0.6 THEN 'info' WHEN confidence < 0.85 THEN 'warning' WHEN multimodal THEN 'critical' ELSE 'warning' END AS severity, n FROM c""")
def combine_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = user_signals(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    c = correlate.combine(correlate.merge_signals(s, ["source", "day"]), ["source", "day"])
    level = correlate.severity(F.col("confidence"), F.col("multimodal"), F.lit(False), F.col("has_log"), F.col("asked_for"))
    return c.select("source", "day", F.round("confidence", 6).alias("confidence"), "multimodal", level.alias("severity"), F.size("signals").cast("long").alias("n"))


@query("""SELECT e.event_id, c.event_id AS change_id, round((epoch_us(c.ts) - epoch_us(e.ts)) / 1e6, 6) AS offset_seconds
  FROM events e JOIN events c ON c.user_id = e.user_id AND c.event_type = 'signup' AND c.ts BETWEEN e.ts - INTERVAL 24 HOUR AND e.ts + INTERVAL 30 SECOND WHERE e.event_type = 'error'""")
def related_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the same user from a day before to half a minute after an error."""
    s = user_signals(spark, sf_dir).withColumnRenamed("seq", "event_id")
    return correlate.related_changes(s, user_changes(spark, sf_dir), horizon_s=86400)


@query("""WITH s AS (SELECT event_id AS seq, user_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT event_id AS change_id, user_id, ts FROM events WHERE event_type = 'signup'),
  free AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = s.user_id AND c.ts BETWEEN s.ts - INTERVAL 15 MINUTE AND s.ts)),
  p AS (SELECT seq, change_id, 'user/' || c.user_id AS echo_source, round((epoch_us(free.ts) - epoch_us(c.ts)) / 1e6, 6) AS delay_seconds
    FROM free JOIN c ON c.user_id <> free.user_id AND c.ts BETWEEN free.ts - INTERVAL 10 MINUTE AND free.ts)
  SELECT seq, change_id, echo_source, delay_seconds FROM p QUALIFY row_number() OVER (PARTITION BY seq ORDER BY delay_seconds, echo_source, change_id) = 1""")
def change_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.echoes(user_signals(spark, sf_dir), user_changes(spark, sf_dir))


_ECHOES = """s AS (SELECT event_id AS seq, user_id, ts, CASE WHEN value > 60 THEN 'log' ELSE 'metric' END AS modality, least(0.95, 0.3 + value / 100) AS score,
    user_id || (value > 60)::VARCHAR || (CAST(json_extract(props, '$.k') AS BIGINT) % 3) AS key FROM events WHERE event_type = 'error'),
  c AS (SELECT event_id AS change_id, user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT change_id, user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM c),
  free AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = s.user_id AND c.ts BETWEEN s.ts - INTERVAL 15 MINUTE AND s.ts)),
  e AS (SELECT free.*, n.user_id AS of, session FROM free JOIN n ON n.user_id <> free.user_id AND n.ts BETWEEN free.ts - INTERVAL 10 MINUTE AND free.ts
    QUALIFY row_number() OVER (PARTITION BY seq ORDER BY free.ts - n.ts, 'user/' || n.user_id, change_id) = 1)"""


@query(f"""WITH {_ECHOES}, m AS (SELECT of, session, key, max(score) AS score FROM e GROUP BY 1, 2, 3),
  x AS (SELECT of, session, least(0.99, 1 - exp(sum(ln(1 - least(score, 0.99))))) AS confidence, count(*) AS n FROM m GROUP BY 1, 2),
  y AS (SELECT of, session, min(ts) AS ts, count(*) AS instances, array_to_string(list_sort(list(DISTINCT 'user/' || user_id)), ',') AS sources FROM e GROUP BY 1, 2),
  z AS (SELECT user_id AS of, session, least(count(*), 64) AS n_changes FROM n GROUP BY 1, 2)
  SELECT 'user/' || of AS source, 'anomaly.change_echo' AS kind, ts, CASE WHEN confidence < 0.6 THEN 'info' ELSE 'warning' END AS severity, round(confidence + 1e-9::DOUBLE, 6) AS confidence, n AS n_signals,
    CAST(instances AS VARCHAR) AS instances, sources, CAST(n_changes AS INTEGER) AS n_changes FROM x JOIN y USING (of, session) JOIN z USING (of, session)""")
def echo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in the wake of other users' signups, an event for each session of signups; confidences are shifted off the ties of rounding."""
    found = correlate.echo_events(user_signals(spark, sf_dir), user_changes(spark, sf_dir))
    return found.select(
        "source", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"), "severity", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), "n_signals",
        F.col("attributes")["signal_instances"].alias("instances"), F.col("attributes")["sources"].alias("sources"), F.size("related_changes").alias("n_changes"),
    )


@query("""WITH o AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT * FROM o WHERE event_type = 'error')
  SELECT f.event_id, coalesce(string_agg(CAST(o.event_id AS VARCHAR), ',' ORDER BY o.n) FILTER (o.n <= f.n), '') AS before,
    coalesce(string_agg(CAST(o.event_id AS VARCHAR), ',' ORDER BY o.n) FILTER (o.n > f.n AND o.ts < f.ts + INTERVAL 6 HOUR), '') AS after
  FROM f JOIN o ON o.user_id = f.user_id AND o.n BETWEEN f.n - 9 AND f.n + 10 GROUP BY f.event_id""")
def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user did up to an error, and in the six hours after it."""
    seen = events(spark, sf_dir).select("source", "ts", F.col("event_id").alias("seq"), "event_type")
    found = seen.filter("event_type = 'error'").select(F.col("seq").alias("event_id"), "source", "ts", F.col("seq").alias("first_seq"))
    near = correlate.event_context(found, seen, 6 * 3600)
    return near.select("event_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT 'user/' || user_id AS source, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_changes FROM n GROUP BY user_id, k""")
def change_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlate.change_sessions(user_changes(spark, sf_dir), echo_s=6 * 3600)
    return found.select("source", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_changes")


@query("""SELECT user_id, event_id, array_to_string(list(event_id) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS before,
  coalesce(array_to_string(list(event_id) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), ','), '') AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("user_id").alias("source"), "ts", F.col("event_id").alias("seq"))
    return correlate.context(rows).select(
        "user_id", F.col("seq").alias("event_id"), F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after")
    )


@query(f"""WITH RECURSIVE s AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY source ORDER BY ts, seq) AS rn FROM ({_SIGNALS})),
  a AS (SELECT source, seq, rn, us AS anchor FROM s WHERE rn = 1 UNION ALL
    SELECT s.source, s.seq, s.rn, CASE WHEN s.us - a.anchor >= 3600000000 THEN s.us ELSE a.anchor END FROM a JOIN s ON s.source = a.source AND s.rn = a.rn + 1),
  m AS (SELECT s.source, anchor, merge_key, any_value(kind) AS kind, any_value(modality) AS modality, max(score) AS score FROM s JOIN a USING (source, seq) GROUP BY 1, 2, 3),
  c AS (SELECT source, anchor, least(0.99, 1 - exp(sum(ln(1 - least(score, 0.99))))) AS confidence, bool_or(modality = 'log') AS has_log, bool_or(modality = 'metric') AS has_metric,
    count(*) AS n, any_value(kind) AS kind FROM m GROUP BY 1, 2),
  r AS (SELECT c.source, anchor, count(e.event_id) AS changes FROM c LEFT JOIN events e ON e.event_type = 'signup' AND 'user/' || e.user_id = c.source
    AND epoch_us(e.ts) - anchor BETWEEN -900000000 AND 3600000000 GROUP BY 1, 2)
  SELECT substr(sha256(source || chr(31) || anchor), 1, 32) AS event_id, CASE WHEN n > 1 THEN 'anomaly.correlated' ELSE 'anomaly.' || kind END AS kind, source, make_timestamp(anchor) AS ts,
    CASE WHEN confidence < 0.6 THEN 'info' WHEN confidence < 0.85 THEN 'warning' WHEN has_log AND (has_metric OR changes > 0) THEN 'critical' ELSE 'warning' END AS severity,
    round(confidence, 6) AS confidence, n AS n_signals, CAST(changes AS INTEGER) AS n_changes FROM c JOIN r USING (source, anchor)""")
def anomaly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From errors as signals to events of windows of an hour, with changes and severity."""
    built = correlate.build_events(user_signals(spark, sf_dir), user_changes(spark, sf_dir), window_s=3600)
    return built.select("event_id", "kind", "source", F.col("ts").cast("timestamp_ntz").alias("ts"), "severity", F.round("confidence", 6).alias("confidence"), "n_signals", F.coalesce(F.size("related_changes"), F.lit(0)).alias("n_changes"))


# ---- incidents


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error' and value > 60")
    return e.select(
        "event_id", "ts", F.concat(F.lit("user/"), (F.col("user_id") % 20).cast("string")).alias("service"),
        F.when(k_of() % 10 == 0, F.array(F.concat(F.lit("deploy "), F.to_date("ts").cast("string")))).alias("change_keys"),
        F.when(F.col("value") > 150, "critical").when(F.col("value") > 100, "warning").otherwise("info").alias("severity"),
        F.least(F.lit(0.99), F.col("value") / 300).alias("confidence"), F.concat(F.lit("value "), F.round("value", 1).cast("string"), F.lit(" (high)")).alias("summary"),
    )


_INCIDENTS = """WITH RECURSIVE e AS (
  SELECT event_id, ts, epoch_us(ts) AS us, 'user/' || user_id % 20 AS service, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0 THEN ['deploy ' || CAST(ts AS DATE)] ELSE CAST([] AS VARCHAR[]) END AS keys,
    CASE WHEN value > 150 THEN 3 WHEN value > 100 THEN 2 ELSE 1 END AS rank, least(0.99, value / 300) AS confidence, 'value ' || round(value, 1) AS summary, row_number() OVER (ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type = 'error' AND value > 60
), f AS (
  SELECT rn, event_id, event_id AS incident_id, [{'id': event_id, 'start': us, 'last': us, 'services': [service], 'changes': keys}] AS open FROM e WHERE rn = 1
  UNION ALL
  SELECT rn, event_id, coalesce(pick, event_id), CASE WHEN pick IS NULL THEN list_append(still, {'id': event_id, 'start': us, 'last': us, 'services': [service], 'changes': keys})
    ELSE list_transform(still, lambda i: CASE WHEN i.id = pick THEN {'id': i.id, 'start': i.start, 'last': us, 'services': list_append(i.services, service), 'changes': list_concat(i.changes, keys)} ELSE i END) END
  FROM (SELECT *, list_filter(related, lambda i: i.last = list_max(list_transform(related, lambda j: j.last)))[1].id AS pick
    FROM (SELECT *, list_filter(still, lambda i: us - i.start <= 3600000000 AND (list_contains(i.services, service) OR list_has_any(i.changes, keys) OR us - i.last <= 30000000)) AS related
      FROM (SELECT e.*, list_filter(f.open, lambda i: e.us - i.last <= 1800000000) AS still FROM f JOIN e ON e.rn = f.rn + 1)))
)"""


@query(f"{_INCIDENTS} SELECT event_id, incident_id FROM f")
def incident_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.group_events(_anomalies(spark, sf_dir))


@query(f"""{_INCIDENTS}, r AS (SELECT f.incident_id, e.* FROM f JOIN e USING (event_id)),
  v AS (SELECT incident_id, service, min(rn) AS first FROM r GROUP BY 1, 2), o AS (SELECT incident_id, list(service ORDER BY first) AS services FROM v GROUP BY 1),
  i AS (SELECT incident_id, min(ts) AS start, max(ts) AS "end", max(rank) AS rank, round(max(confidence), 6) AS confidence, count(*) AS n_events, arg_min(service, rn) AS service, arg_min(summary, rn) AS summary FROM r GROUP BY 1)
  SELECT incident_id, start, "end", CASE rank WHEN 3 THEN 'critical' ELSE 'warning' END AS severity, confidence, n_events, array_to_string(services, ',') AS services,
    service || ': ' || summary || CASE WHEN len(services) = 2 THEN ' (+1 service)' WHEN len(services) > 2 THEN ' (+' || (len(services) - 1) || ' services)' ELSE '' END AS title
  FROM i JOIN o USING (incident_id) WHERE rank >= 2""")
def incident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _anomalies(spark, sf_dir)
    found = incidents.incident_table(a, incidents.group_events(a))
    return incidents.incident_list(found, least="warning").select("incident_id", "start", "end", "severity", F.round("confidence", 6).alias("confidence"), "n_events", F.array_join("services", ",").alias("services"), "title")


@query("""SELECT 'day ' || CAST(ts AS DATE) AS incident_id, event_type AS kind, 'user/' || user_id % 20 AS source, count(*) AS n_signals, round(max(value), 6) AS score,
    'event ' || arg_max(event_id, (value, event_id)) AS summary, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2, 3""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("day "), F.to_date("ts").cast("string")).alias("incident_id"), F.col("event_type").alias("kind"), F.concat(F.lit("user/"), (F.col("user_id") % 20).cast("string")).alias("source"),
        F.col("value").alias("score"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("summary"), "ts", F.col("event_id").alias("seq"),
    )
    return incidents.evidence(e).withColumn("score", F.round("score", 6))


# ---- reads


@query("""SELECT * FROM (SELECT event_id, ts, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 500)""")
def events_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return readapi.newest(e, F.expr("TIMESTAMP_NTZ '2024-01-10'"), F.expr("TIMESTAMP_NTZ '2024-01-20'"))


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readapi.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100, 50)


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'econ')""")
def parts_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return readapi.containing(p, ["p_name"], "RING").union(readapi.containing(p, ["p_type"], "Econ")).distinct()


@query("""WITH u AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS std_dev, arg_max(value, (ts, event_id)) AS recent FROM events GROUP BY 1), s AS (SELECT *, CASE WHEN std_dev > 0 THEN (recent - mean) / std_dev ELSE 0 END AS sigma FROM u)
  SELECT 'user/' || user_id AS series, round(sigma, 6) AS sigma, CASE WHEN abs(sigma) >= 3 THEN 'hot' WHEN abs(sigma) >= 1 THEN 'warm' ELSE 'calm' END AS band, round(least(1, abs(sigma) / 12), 6) AS bar FROM s""")
def series_by_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("user/"), "user_id").alias("series")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_dev"), F.max_by("value", F.struct("ts", "event_id")).alias("recent")
    )
    return readapi.series_by_sigma(u).select("series", F.round("sigma", 6).alias("sigma"), "band", F.round("bar", 6).alias("bar"))


@query("""WITH o AS (SELECT o_orderkey, 'Cust' || o_custkey % 50 AS identifier, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 3 > 0 THEN 'unit-' || (o_custkey % 50) || CASE WHEN o_custkey % 50 < 5 AND o_orderkey % 2 = 0 THEN 'b' ELSE '' END END AS unit FROM orders),
  k AS (SELECT lower(identifier) AS id, min(unit) AS only_unit FROM o WHERE unit IS NOT NULL GROUP BY 1 HAVING count(DISTINCT unit) = 1)
  SELECT o_orderkey, identifier, unit, coalesce(unit, only_unit) AS resolved FROM o LEFT JOIN k ON lower(identifier) = id""")
def unit_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.col("o_custkey") % 50
    unit = F.concat(F.lit("unit-"), group.cast("string"), F.when((group < 5) & (F.col("o_orderkey") % 2 == 0), "b").otherwise(""))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("Cust"), group.cast("string")).alias("identifier"), F.when((F.col("o_orderstatus") != "P") & (F.col("o_custkey") % 3 > 0), unit).alias("unit")
    )
    return readapi.resolve_units(o, "identifier", "unit")


@query("""SELECT c_custkey, coalesce(n_name, 'nation ' || c_nationkey) AS n_name, c_mktsegment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""")
def directory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return readapi.lookup(c, d, "c_nationkey", "n_name", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).select("c_custkey", "n_name", "c_mktsegment")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS image, o_orderstatus AS restarted, CAST(o_totalprice / 100000 AS BIGINT) AS replicas FROM orders),
  p AS (SELECT *, lag(image) OVER w AS image0, lag(restarted) OVER w AS restarted0, lag(replicas) OVER w AS replicas0, lag(o_orderkey) OVER w AS key0 FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  SELECT o_custkey, o_orderkey, CASE WHEN image <> image0 THEN 'deployment' WHEN restarted <> restarted0 THEN 'restart' WHEN replicas <> replicas0 THEN 'scale' ELSE 'config' END AS type FROM p WHERE key0 IS NOT NULL""")
def workload_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generation of a workload against the one before, from documents of its state."""
    o = table(spark, sf_dir, "orders")
    name = F.lit("main").alias("name")
    meta = F.struct(F.struct(F.col("o_orderstatus").alias("kubectl.kubernetes.io/restartedAt")).alias("annotations"))
    template = F.struct(meta.alias("metadata"), F.struct(F.array(F.struct(name, F.col("o_orderpriority").alias("image"))).alias("containers")).alias("spec"))
    state = F.struct(
        F.struct(F.col("o_custkey").cast("string").alias("uid"), name, F.col("o_orderkey").alias("generation")).alias("metadata"),
        F.struct(F.round(F.col("o_totalprice") / 100000).cast("long").alias("replicas"), template.alias("template")).alias("spec"),
    )
    found = documents.workload_changes(o.select(F.to_json(state).alias("value")))
    return found.select(F.col("uid").cast("long").alias("o_custkey"), F.col("generation").alias("o_orderkey"), "type")


@query(f"WITH l AS ({_LINES}) SELECT doc_id, line_no, md5(line) AS line_md5 FROM l")
def response_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the responses of two polls that overlap give them, each once."""
    lines = F.transform(F.split("text", "\n"), lambda line, at: F.array((at.cast("long") * 1_000_000).cast("string"), line))
    stream = F.struct(F.create_map(F.lit("doc"), F.col("doc_id").cast("string")).alias("stream"), lines.alias("values"))
    answer = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.struct(F.array(stream).alias("result")).alias("data"))).alias("value"))
    found = documents.log_responses(answer.union(answer))
    line_no = F.round(F.unix_micros("timestamp") / 1000).cast("int")
    return found.select(F.col("labels")["doc"].cast("long").alias("doc_id"), line_no.alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("""WITH s AS (SELECT user_id, ts, event_id % 1000 AS user, CAST(json_extract(props, '$.k') AS BIGINT) AS system, epoch_us(ts) // 1000000 AS idle, event_id % 7 AS wait FROM events),
  d AS (SELECT user_id, ts, user + system + idle + wait - lag(user + system + idle + wait) OVER w AS total, idle + wait - lag(idle + wait) OVER w AS idle FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  SELECT user_id, ts, round(100.0::DOUBLE * (total - idle) / total, 6) AS cpu_percent FROM d WHERE total > 0""")
def host_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of time busy, from kernel counters of hosts."""
    e = events(spark, sf_dir)
    seconds_ = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    line = F.concat_ws(" ", F.lit("cpu "), F.col("event_id") % 1000, F.lit(0), k_of(), seconds_, F.col("event_id") % 7, F.lit(0), F.lit(0), F.lit(0), F.lit(99), F.lit(0))
    found = documents.host_cpu(e.select(F.col("user_id").alias("host"), "ts", line.alias("line")))
    return found.select(F.col("host").alias("user_id"), "ts", F.round("cpu_percent", 6).alias("cpu_percent"))


@query("""SELECT user_id AS host, event_id AS ts, 'system.memory.used_percent' AS name, round(100.0::DOUBLE * (1 - CAST(json_extract(props, '$.k') AS DOUBLE) / (1000 + event_id)), 6) AS value, '' AS path FROM events
  UNION ALL SELECT user_id, event_id, 'system.load1', round(value, 6), '' FROM events
  UNION ALL SELECT user_id, event_id, 'system.disk.used_percent', round(100.0::DOUBLE * (1 - (event_id % 1000) / (event_id % 5 * 1000.0::DOUBLE)), 6), '/' || event_type FROM events WHERE event_id % 5 > 0""")
def host_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory, load and disks of hosts, from the kernel's tables."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("host"), F.col("event_id").alias("ts"), "value", "event_type", k_of().alias("k"))
    table_ = F.concat(F.lit("MemTotal:  "), (F.col("ts") + 1000).cast("string"), F.lit(" kB\nMemFree: 1 kB\nMemAvailable: "), F.col("k").cast("string"), F.lit(" kB\nBuffers: 2 kB"))
    disks = e.select("host", "ts", F.concat(F.lit("/"), "event_type").alias("path"), (F.col("ts") % 5 * 1000).alias("blocks"), (F.col("ts") % 1000).alias("available"))
    load = e.select("host", "ts", F.concat_ws(" ", F.col("value").cast("string"), F.lit("0.50 0.25 1/200 4711")).alias("line"))
    cpu = e.limit(0).select("host", "ts", F.lit(0.0).alias("cpu_percent"))  # host_cpu has a query of its own
    found = documents.host_samples(cpu, documents.host_memory(e.select("host", "ts", table_.alias("text"))), documents.host_load(load), documents.host_disks(disks))
    return found.select("host", "ts", "name", F.round("value", 6).alias("value"), F.coalesce(F.col("labels")["path"], F.lit("")).alias("path"))


@query("""WITH s AS (SELECT user_id % 50 AS resource, CAST(ts AS DATE) AS day, user_id, avg(value) AS cpu, count(*) AS n FROM events GROUP BY ALL),
  w AS (SELECT resource, day, avg(cpu) AS cpu, CAST(sum(n) AS DOUBLE) AS requests FROM s GROUP BY ALL)
  SELECT resource, day, 'serverless.cpu.percent' AS name, round(cpu, 6) AS value FROM w UNION ALL SELECT resource, day, 'serverless.requests_per_second', requests FROM w""")
def resource_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container's instances as one series."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("resource"), F.to_date("ts").alias("ts"), "user_id").agg(F.avg("value").alias("cpu"), F.count("*").cast("double").alias("n"))
    labels = F.create_map(F.lit("resource_id"), F.col("resource").cast("string"), F.lit("region"), F.lit("here"), F.lit("resource_instance"), F.col("user_id").cast("string")).alias("labels")
    rows = [e.select("ts", F.lit(f"serverless_container_{name}").alias("name"), F.col(c).alias("value"), labels) for name, c in (("cpu_usage_ratio", "cpu"), ("requests_per_second", "n"))]
    found = documents.resource_metrics(rows[0].union(rows[1]))
    return found.select(F.col("resource_id").cast("long").alias("resource"), F.col("ts").alias("day"), "name", F.round("value", 6).alias("value"))


@query("""WITH s AS (SELECT user_id, ts, event_id AS used, epoch_us(ts) AS system, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
  d AS (SELECT *, used - lag(used) OVER w AS du, system - lag(system) OVER w AS ds FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  SELECT user_id, ts, CASE WHEN ds > 0 THEN round(100.0::DOUBLE * du / ds * 4, 6) END AS cpu_percent, 2000 - k AS memory, round(100 * (2000 - k) / 4000, 6) AS memory_percent FROM d""")
def container_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processor and memory of containers, from documents of their counters."""
    e = events(spark, sf_dir)
    cpu = F.struct(F.struct(F.col("event_id").alias("total_usage")).alias("cpu_usage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("system_cpu_usage"), F.lit(4).alias("online_cpus"))
    memory = F.struct(F.lit(2000).alias("usage"), F.lit(4000).alias("limit"), F.struct(k_of().alias("inactive_file")).alias("stats"))
    found = documents.container_usage(e.select(F.col("user_id").alias("container"), "ts", F.to_json(F.struct(cpu.alias("cpu_stats"), memory.alias("memory_stats"))).alias("stats")))
    return found.select(F.col("container").alias("user_id"), "ts", F.round("cpu_percent", 6).alias("cpu_percent"), "memory", F.round("memory_percent", 6).alias("memory_percent"))


@query(f"WITH l AS ({_LINES}) SELECT md5(line) AS line_md5, min(doc_id) AS doc_id, count(*) AS n FROM l GROUP BY line")
def cursor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a poll reads again at its inclusive border, once."""
    return _lines(spark, sf_dir).groupBy("line").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select(F.md5(F.col("line").cast("binary")).alias("line_md5"), "doc_id", "n")


@query("""SELECT 'event' AS modality, event_id AS id, ts, value FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate, o_totalprice FROM orders""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("modality"), F.col("event_id").alias("id"), "ts", "value")
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("modality"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return lines.union(e, o)


@query("""WITH g AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY 1), s AS (SELECT user_id, us / 1e6 AS s, CAST(round(us / 3.6e9) AS BIGINT) AS h FROM g)
  SELECT user_id, h // 24 || 'd' || CASE WHEN h % 24 > 0 THEN ' ' || h % 24 || 'h' ELSE '' END AS span FROM s WHERE s >= 86400""")
def active_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(((F.max(us) - F.min(us)) / 1e6).alias("s"))
    return g.filter("s >= 86400").select("user_id", series.humanized(F.col("s")).alias("span"))


# ---- decoders, stored events, what was learned, and streams, through the library's operators


@query("""SELECT event_id, event_type || ' took ' || CAST(json_extract(props, '$.k') AS BIGINT) || ' ms' AS message,
    CASE user_id % 3 WHEN 0 THEN 'app-' || user_id WHEN 1 THEN 'session' ELSE 'cron' END AS service, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END AS level, ts FROM events""")
def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as export documents of a journal: texts or bytes, units that stay or come and go, or none."""
    e = events(spark, sf_dir)
    message = F.concat_ws(" ", "event_type", F.lit("took"), k_of().cast("string"), F.lit("ms"))
    user = F.col("user_id").cast("string")
    unit = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("app-"), user, F.lit(".service"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("session-"), user, F.lit(".scope")))
    common = [
        unit.alias("_SYSTEMD_UNIT"), F.lit("CRON").alias("SYSLOG_IDENTIFIER"), F.element_at(F.array(F.lit("3"), F.lit("4"), F.lit("6")), (F.col("event_id") % 3 + 1).cast("int")).alias("PRIORITY"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("__REALTIME_TIMESTAMP"), F.col("event_id").cast("string").alias("__CURSOR"),
    ]
    bytes_ = F.transform(F.split(message, ""), lambda c: F.ascii(c))
    odd = F.col("event_id") % 2 == 1
    docs = e.filter(~odd).select(F.to_json(F.struct(message.alias("MESSAGE"), *common)).alias("value")).union(e.filter(odd).select(F.to_json(F.struct(bytes_.alias("MESSAGE"), *common)).alias("value")))
    return documents.journal_entries(docs).select(F.col("cursor").cast("long").alias("event_id"), "message", "service", "level", F.col("timestamp").cast("timestamp_ntz").alias("ts"))


@query("""SELECT event_id, 'pod-' || user_id AS service, 'prod' AS namespace, event_type || ' Pod/pod-' || user_id || ': number ' || event_id AS message,
    CASE WHEN event_type = 'error' THEN 'warn' ELSE 'info' END AS level FROM events WHERE event_id % 5 > 0""")
def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as watch frames of a cluster; those that delete say nothing."""
    e = events(spark, sf_dir)
    pod = F.concat(F.lit("pod-"), F.col("user_id").cast("string"))
    frame = F.struct(
        F.when(F.col("event_id") % 5 == 0, "DELETED").when(F.col("event_id") % 2 == 0, "ADDED").otherwise("MODIFIED").alias("type"),
        F.struct(
            F.struct(pod.alias("name"), F.lit("Pod").alias("kind")).alias("involvedObject"), F.struct(F.lit("prod").alias("namespace")).alias("metadata"), F.col("event_type").alias("reason"),
            F.concat(F.lit("number "), F.col("event_id").cast("string")).alias("message"), F.when(F.col("event_type") == "error", "Warning").otherwise("Normal").alias("type"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastTimestamp"),
        ).alias("object"),
    )
    found = documents.cluster_events(e.select(F.to_json(frame).alias("value")))
    return found.select(F.regexp_extract("message", r"number (\d+)$", 1).cast("long").alias("event_id"), "service", "namespace", "message", "level")


@query("""SELECT user_id, event_type AS service, max(value) AS value FROM events GROUP BY ALL UNION ALL SELECT NULL, 'all', CAST(count(*) AS DOUBLE) FROM events""")
def metric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value of users by type as a vector of answers to a metric query, and the number of events as a scalar; the label that the query names is the service."""
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    result = lambda kind, value: F.to_json(F.struct(F.struct(F.lit(kind).alias("resultType"), value.alias("result")).alias("data"))).alias("value")
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    vector = e.select(result("vector", F.array(F.struct(labels.alias("metric"), F.array(F.lit("1700000000.5"), F.col("value").cast("string")).alias("value")))))
    scalar = events(spark, sf_dir).agg(F.count("*").alias("n")).select(result("scalar", F.array(F.lit("1700000000"), F.col("n").cast("string"))))
    found = documents.metric_responses(vector.union(scalar))
    return found.select(F.col("labels")["user"].cast("long").alias("user_id"), documents.sample_service(F.col("labels"), "type", "all", "none").alias("service"), "value")


@query("""SELECT CAST(event_id AS VARCHAR) AS id, ts AS timestamp, event_type AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""")
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the log, appended in two batches that overlap, and read back between two times."""
    e = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("kind"), F.col("event_id") % 3 < 2)
    path, part = new_path(spark), e.columns[-1]
    event_log.append(e.filter(F.col(part)).drop(part), path, F.to_date("timestamp"))
    event_log.append(event_log.append_new(e.drop(part), event_log.stored_ids(spark, path)), path, F.to_date("timestamp"))
    found = event_log.query(spark, path, "id string, timestamp timestamp, kind string", "2024-01-10", "2024-01-20")
    return found.select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "kind")


@query("""WITH t AS (SELECT 'prod/' || user_id AS source, event_type || ' ' || CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS template, count(*) AS size FROM events GROUP BY ALL)
  SELECT source, template, size, CASE template WHEN 'error 1' THEN 'symptomatic' ELSE 'heartbeat' END AS marking FROM t WHERE template IN ('error 1', 'view 0') AND (contains(template, 'error') OR contains(source, 'error'))""")
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that are marked and contain a text, in any case."""
    t = log_rows(spark, sf_dir).groupBy("source", "template_id", "template").agg(F.count("*").alias("size"))
    marks = spark.createDataFrame([("template", "error 1", "symptomatic"), ("template", "view 0", "heartbeat"), ("pattern", "view*", "normal")], "kind string, name string, marking string")
    return readapi.template_rows(t, marks, "ERROR", "any").select("source", "template", "size", "marking")


@query(f"""{_EWMA}, last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY rn DESC) = 1)
  SELECT series, CAST(n2 AS BIGINT) AS samples, round(mean2, 6) AS mean, n2 < 30 AS warmup,
    CASE WHEN n2 < 30 THEN NULL WHEN variance2 > 0 THEN round(abs(fast2 - mean2) / sqrt(variance2), 6) WHEN fast2 <> mean2 THEN 'inf'::DOUBLE ELSE 0 END AS deviation FROM last""")
def learned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metric detector has learned, read from the tables that a run leaves."""
    folder = new_path(spark)
    metric_detector.judge(samples(spark, sf_dir), metric_detector.MetricConfig(daily=False), resume=Resume(f"{folder}/metrics"))
    return state.series(spark, folder).select("series", "samples", F.round("mean", 6).alias("mean"), "warmup", F.round("deviation", 6).alias("deviation"))


@query(f"""{_EWMA}, last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY rn DESC) = 1)
  SELECT series, CAST(n2 AS BIGINT) AS samples FROM last WHERE NOT regexp_full_match(series, 'prod/1[^/]*/value')""")
def forgotten_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of what was learned after some series are forgotten."""
    before, after = new_path(spark), new_path(spark)
    metric_detector.judge(samples(spark, sf_dir), metric_detector.MetricConfig(daily=False), resume=Resume(f"{before}/metrics"))
    state.forget_series(spark, before, after, "prod/1*/value")
    return state.series(spark, after).select("series", "samples")


@query("""WITH e AS (SELECT event_id, 'prod/' || user_id AS source, event_type AS a, CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS VARCHAR) AS b FROM events)
  SELECT event_id, CASE WHEN b = '1' AND a = 'error' THEN '2' WHEN a = 'error' THEN '2' WHEN b = '1' THEN '3' WHEN a = 'view' AND b = '0' THEN '1' END AS template_id FROM e""")
def matched_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and the template of their source that they fit: of several the one with the most parameters, then the smallest number."""
    rows = log_rows(spark, sf_dir).select("source", F.col("seq").alias("event_id"), F.split("template", " ").alias("words"))
    each = F.explode(F.array(*[F.struct(F.lit(str(k + 1)).alias("template_id"), F.lit(t).alias("template")) for k, t in enumerate(("view 0", "error <*>", "<*> 1", "click 9"))])).alias("t")
    own = rows.select("source").distinct().select("source", each).select("source", "t.*")
    return mining.match_templates(rows, own).select("event_id", "template_id")


@query(f"{_INCIDENTS} SELECT event_id, incident_id FROM f")
def streamed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of incidents as a stream gives them, which takes all events and ends; a later row moves the watermark past the last."""
    a = _anomalies(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "service", "change_keys")
    end = a.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).filter("ts is not null").select(F.lit("end").alias("event_id"), "ts", F.lit("").alias("service"), F.lit(None).cast("array<string>").alias("change_keys"))
    source, out = new_path(spark), new_path(spark)
    a.union(end).write.parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        found = correlation.incident_members(spark.readStream.schema(a.schema).parquet(source))
        sink = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark))
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    rows = spark.read.schema(found.schema).parquet(out).filter("not closed and event_id <> 'end'")
    return rows.select(F.col("event_id").cast("long").alias("event_id"), F.col("incident_id").cast("long").alias("incident_id"))


#: Of each event of a user and type, in order of time, how many other such series came since that series' last (none: 1e9).
_DISTANCES = """e AS (SELECT event_id, user_id || '/' || event_type AS key, row_number() OVER (ORDER BY ts, event_id) AS i FROM events WHERE isfinite(value)),
  p AS (SELECT *, lag(i) OVER (PARTITION BY key ORDER BY i) AS prev FROM e),
  d AS (SELECT a.i, a.event_id, a.key, a.prev, if(count(a.prev) = 0, 1000000000, count(b.i)) AS distance
    FROM p a LEFT JOIN p b ON b.i > a.prev AND b.i < a.i AND (b.prev IS NULL OR b.prev < a.prev) GROUP BY a.i, a.event_id, a.key, a.prev)"""


def _typed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.concat_ws("/", "user_id", "event_type")
    return events(spark, sf_dir).select(series.alias("series"), F.lit("value").alias("metric"), "event_id", "ts", "value")


@query(f"""WITH {_DISTANCES}, g AS (SELECT *, sum(CAST(distance >= 60 AS INT)) OVER (PARTITION BY key ORDER BY i) AS life FROM d)
  SELECT event_id, key AS series, CAST(row_number() OVER (PARTITION BY key, life ORDER BY i) - 1 AS BIGINT) AS n FROM g""")
def limited_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples each series had when a sample came, with 60 series remembered at most."""
    judged = metric_detector.judge(_typed_series(spark, sf_dir), metric_detector.MetricConfig(max_series=60, ttl_us=1 << 60))
    return judged.select("event_id", "series", "n")


@query(f"""WITH RECURSIVE {_DISTANCES}, r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS held, false AS fresh
    UNION ALL SELECT d.i, CASE WHEN distance < held THEN held WHEN held >= 60 THEN 60 - 7 + 1 ELSE held + 1 END, distance >= held FROM r JOIN d ON d.i = r.i + 1)
  SELECT event_id, key AS series FROM r JOIN d USING (i) WHERE fresh AND prev IS NOT NULL""")
def forgotten_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where patterns come again that were forgotten, with 60 remembered at most, of which the oldest tenth and one go for a new one."""
    rows = _typed_series(spark, sf_dir).filter(F.abs("value") < float("inf"))
    found = caps.marked(rows, ["series"], ["ts", "event_id"], 60, 60 // 10 + 1)
    first = F.row_number().over(Window.partitionBy("series").orderBy("ts", "event_id")) == 1
    return found.withColumn("first", first).filter("fresh and not first").select("event_id", "series")
