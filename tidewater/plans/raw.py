"""Queries over raw sources: text parsing, multi-rate windows, spectral features, the synthetic fixture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signal, validate
from ..sources import nested_signals, synthetic, text_series
from .frames import EPOCHS_SQL, epochs, rounded, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query(
    "text_series_parse",
    """WITH l AS (SELECT user_id, event_id AS line, CASE WHEN event_id % 11 = 0 THEN '# ' ELSE '' END || CASE WHEN event_id % 13 = 0 THEN 'x' ELSE event_id::VARCHAR END || CASE WHEN event_id % 2 = 0 THEN ', ' ELSE '  ' END || CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE round(value, 2)::VARCHAR END || ' # ' || event_type AS s FROM events),
  b AS (SELECT user_id, line, regexp_split_to_array(trim(regexp_replace(s, '#.*', '')), '\\s*,\\s*|\\s+') AS c FROM l WHERE trim(regexp_replace(s, '#.*', '')) <> '')
  SELECT user_id, line, try_cast(c[1] AS DOUBLE) AS t, try_cast(c[2] AS DOUBLE) AS v, len(c) >= 2 AS whole FROM b WHERE try_cast(c[1] AS DOUBLE) IS NOT NULL""",
)
def text_series_parse(spark, d):
    e = table(spark, d, "events")
    s = F.concat(F.when(F.col("event_id") % 11 == 0, "# ").otherwise(""), F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("event_id").cast("string")), F.when(F.col("event_id") % 2 == 0, ", ").otherwise("  "), F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.round("value", 2).cast("string")), F.lit(" # "), F.col("event_type"))
    out = text_series.parse_lines(e.select("user_id", F.col("event_id").alias("line"), s.alias("value")), 2, ["user_id"])
    return out.select("user_id", "line", "t", F.get("v", F.lit(0)).alias("v"), "whole")


@query(
    "multirate_windows",
    """WITH e AS (SELECT user_id::VARCHAR AS c, row_number() OVER (PARTITION BY user_id, ch ORDER BY event_id) - 1 AS idx, ch, fs, value FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'EDA' ELSE 'BVP' END AS ch, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS fs FROM events)),
  s AS (SELECT c, max(n) AS s FROM (SELECT c, ch, (max(idx) + 1) / any_value(fs) AS n FROM e GROUP BY c, ch) GROUP BY c),
  w AS (SELECT c, win FROM s, range(0, 20) r(win) WHERE win <= floor((s - 10) / 5)), j AS (SELECT e.c, ch, win, value, fs FROM w JOIN e ON e.c = w.c AND idx >= round_even(win * 5 * fs, 0) AND idx < round_even((win * 5 + 10) * fs, 0))
  SELECT c AS client_id, ch AS channel, win, count(*) AS n, round(avg(value), 6) AS mean FROM j GROUP BY c, ch, win HAVING count(*) >= 0.9 * 10 * any_value(fs)""",
)
def multirate_windows(spark, d):
    e = table(spark, d, "events").withColumn("channel", F.when(F.col("event_id") % 3 == 0, "EDA").otherwise("BVP"))
    i = F.expr("row_number() over (partition by user_id, channel order by event_id) - 1").cast("long")
    samples = e.select(F.col("user_id").cast("string").alias("client_id"), F.lit("wrist").alias("device"), "channel", F.when(F.col("channel") == "EDA", 1.0).otherwise(2.0).alias("fs"), i.alias("idx"), "value")
    out = nested_signals.window_samples(samples, 10.0, 5.0)
    return rounded(out.groupBy("client_id", "channel", "win").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query(
    "spectral_features",
    f"""WITH {EPOCHS_SQL}, x AS (SELECT client_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY client_id) AS n, value AS x, value - lag(value) OVER w AS d FROM epochs WINDOW w AS (PARTITION BY client_id ORDER BY t, event_id)),
  g AS (SELECT client_id, n, seg, i - 16 * seg AS j, x FROM x, range(0, 100) r(seg) WHERE n >= 32 AND 16 * seg + 32 <= n AND i >= 16 * seg AND i < 16 * seg + 32),
  c AS (SELECT client_id, seg, j, (x - avg(x) OVER (PARTITION BY client_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS x FROM g),
  f AS (SELECT client_id, seg, k, sum(x * cos(2 * pi() * j * k / 32)) AS re, sum(x * sin(2 * pi() * j * k / 32)) AS im FROM c, range(0, 17) r(k) GROUP BY client_id, seg, k),
  p AS (SELECT client_id, k, avg((re * re + im * im) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) AS p FROM f GROUP BY client_id, k), q AS (SELECT client_id, k, k / 8.0 AS hz, p / sum(p) OVER (PARTITION BY client_id) AS q FROM p),
  a AS (SELECT client_id, -sum(q * ln(q + 1e-15)) / ln(17) AS spec_entropy, arg_max(hz, CASE WHEN k > 0 THEN q ELSE -1 END) AS dominant_hz, sum(CASE WHEN hz < 0.05 THEN q ELSE 0 END) AS lo, sum(CASE WHEN hz >= 0.05 AND hz < 0.5 THEN q ELSE 0 END) AS hi FROM q GROUP BY client_id)
  SELECT client_id, 'eda_wrist_spec_entropy' AS feature, round(spec_entropy, 6) AS value FROM a UNION ALL SELECT client_id, 'eda_wrist_dominant_hz', round(dominant_hz, 6) FROM a UNION ALL SELECT client_id, 'eda_wrist_power_0_0.05', round(lo, 6) FROM a UNION ALL SELECT client_id, 'eda_wrist_power_0.05_0.5', round(hi, 6) FROM a
  UNION ALL SELECT client_id, 'eda_wrist_positive_diff_mean', round(sum(greatest(d, 0)) / count(d), 6) FROM x GROUP BY client_id HAVING count(*) >= 16""",
)
def spectral_features(spark, d):
    """Events of a user as an EDA signal of 4 Hz; the SQL twin is a plain Fourier sum."""
    e = epochs(spark, d).select("client_id", F.struct("t", "event_id").alias("at"), "value").withColumn("at", F.row_number().over(Window.partitionBy("client_id").orderBy("at")))
    return rounded(signal.group_features(e, ["client_id"], "at", "value", 4.0, "eda_wrist"), 6)


@query("synthetic_fixture", "SELECT dataset, 8::BIGINT AS clients, 800::BIGINT AS epochs, 0::BIGINT AS violations FROM (VALUES ('WESAD'), ('SLEEP')) t(dataset)")
def synthetic_fixture(spark, d):
    f = synthetic.fixture(spark)
    bad = validate.violations(f, 0.0, validate.sensor_columns(f)).agg(F.sum("violations").alias("violations"))
    return f.groupBy("dataset").agg(F.countDistinct("client_id").alias("clients"), F.count(F.lit(1)).alias("epochs")).crossJoin(bad)  # one row
