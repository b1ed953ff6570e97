"""Queries over recordings: statistics, windows, range joins, runs, rolling frames, validation, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, stats, windows
from .frames import EPOCHS_SQL, epochs, rounded, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _stats_sql(value: str, prefix: str) -> str:
    return f"""SELECT client_id, round(avg(x), 6) AS {prefix}_mean, round(stddev_pop(x), 6) AS {prefix}_std, round(median(abs(x - m)), 6) AS {prefix}_mad,
  round(sqrt(avg(x * x)), 6) AS {prefix}_rms, round(coalesce(regr_slope(x, i * 30.0), 0), 6) AS {prefix}_slope, round(coalesce(avg(d), 0), 6) AS {prefix}_dmean,
  count(x) AS {prefix}_n, round(quantile_cont(x, 0.1), 6) AS {prefix}_p10, round(quantile_cont(x, 0.5), 6) AS {prefix}_median,
  round(quantile_cont(x, 0.9), 6) AS {prefix}_p90, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS {prefix}_iqr
  FROM (SELECT client_id, {value} AS x, row_number() OVER w - 1 AS i, abs({value} - lag({value}) OVER w) AS d, quantile_cont({value}, 0.5) OVER (PARTITION BY client_id) AS m
    FROM epochs WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY t, event_id)) GROUP BY client_id"""


@query("basic_stats_user", f"WITH {EPOCHS_SQL} {_stats_sql('gappy', 'value')}")
def basic_stats_user(spark, d):
    return rounded(stats.basic_stats(epochs(spark, d), ["client_id"], ["t", "event_id"], "gappy", "value", 30.0))


def _axis(a: str, p: str) -> str:
    return f"""round(avg({a}), 6) AS {p}_mean, round(stddev_pop({a}), 6) AS {p}_std, round(sqrt(avg({a} * {a})), 6) AS {p}_rms, count({a}) AS {p}_n, round(quantile_cont({a}, 0.1), 6) AS {p}_p10,
  round(quantile_cont({a}, 0.5), 6) AS {p}_median, round(quantile_cont({a}, 0.9), 6) AS {p}_p90, round(quantile_cont({a}, 0.75) - quantile_cont({a}, 0.25), 6) AS {p}_iqr"""


@query(
    "axis_magnitude_stats",
    f"""WITH x AS (SELECT l_suppkey, l_quantity AS q, l_discount * 100 AS di, l_tax * 100 AS ta FROM lineitem),
  m AS (SELECT *, sqrt(q * q + di * di + ta * ta) AS mag FROM x), c AS (SELECT *, quantile_cont(mag, 0.5) OVER (PARTITION BY l_suppkey) AS med FROM m)
  SELECT l_suppkey, {_axis('mag', 'acc_mag')}, {_axis('q', 'acc_q')}, {_axis('di', 'acc_di')}, {_axis('ta', 'acc_ta')}, round(avg(abs(mag - med)), 6) AS acc_activity FROM c GROUP BY l_suppkey""",
)
def axis_magnitude_stats(spark, d):
    x = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("di"), (F.col("l_tax") * 100).alias("ta"))
    out = stats.axis_stats(x, ["l_suppkey"], ["q", "di", "ta"], ["q", "di", "ta"], "acc")
    # order-dependent statistics are left out here: lineitem has no unique order
    return rounded(out.select(*[c for c in out.columns if not c.endswith(("_mad", "_slope", "_dmean"))]))


@query("robust_scale_groups", f"""WITH {EPOCHS_SQL} SELECT client_id, round(CASE WHEN count(gappy) >= 4 THEN greatest((quantile_cont(gappy, 0.75) - quantile_cont(gappy, 0.25)) / 1.349, stddev_pop(gappy) * 0.05, 1e-6) ELSE 1 END, 6) AS scale FROM epochs GROUP BY client_id""")
def robust_scale_groups(spark, d):
    return rounded(windows.scale_of(epochs(spark, d), ["client_id"], "gappy"))


BOOT = 200


@query(
    "bootstrap_ci",
    f"""WITH {EPOCHS_SQL}, u AS (SELECT client_id, avg(value) AS x FROM epochs GROUP BY client_id), g AS (SELECT CASE WHEN length(client_id) % 2 = 0 THEN 'a' ELSE 'b' END AS grp, client_id, x FROM u),
  n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY client_id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM g),
  draws AS (SELECT grp, rep, ('0x' || substr(sha256('5:' || rep || ':' || i), 1, 8))::BIGINT % 1073741824 % n AS pick FROM n, range({BOOT}) r(rep)),
  means AS (SELECT d.grp, rep, avg(x) AS m FROM draws d JOIN n ON n.grp = d.grp AND n.i = d.pick GROUP BY d.grp, rep),
  b AS (SELECT grp, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY grp)
  SELECT grp, round(avg(x), 6) AS mean, count(*) AS n, round(CASE WHEN count(*) >= 6 THEN any_value(lo) END, 6) AS ci_low, round(CASE WHEN count(*) >= 6 THEN any_value(hi) END, 6) AS ci_high FROM g JOIN b USING (grp) GROUP BY grp""",
)
def bootstrap_ci(spark, d):
    users = epochs(spark, d).groupBy("client_id").agg(F.avg("value").alias("x")).withColumn("grp", F.when(F.length("client_id") % 2 == 0, "a").otherwise("b"))
    return rounded(stats.bootstrap_mean(users, ["grp"], "client_id", "x", BOOT, 5))


DAY = 86400.0


@query(
    "sliding_windows_full_only",
    f"""WITH {EPOCHS_SQL}, s AS (SELECT client_id, min(t) AS a, max(t) AS b FROM epochs GROUP BY client_id),
  w AS (SELECT client_id, win, a + win * {DAY / 2} AS start, a + win * {DAY / 2} + {DAY} AS stop FROM s, range(0, 100) r(win) WHERE win <= floor((b - a - {DAY}) / {DAY / 2}))
  SELECT w.client_id, win, round(start, 3) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM w JOIN epochs e ON e.client_id = w.client_id AND e.t >= start AND e.t < stop GROUP BY w.client_id, win, start""",
)
def sliding_windows_full_only(spark, d):
    e = epochs(spark, d)
    w = joins.sliding_windows(e, "client_id", "t", DAY, DAY / 2)
    met = joins.range_join(w, e, "client_id", F.col("start"), F.col("stop"), "t", DAY)
    return met.groupBy("client_id", "win", F.round("start", 3).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "label_gate_windows",
    f"""WITH {EPOCHS_SQL}, s AS (SELECT client_id, min(t) AS a, max(t) AS b FROM epochs GROUP BY client_id),
  w AS (SELECT client_id, win, a + win * {DAY / 2} AS start, a + win * {DAY / 2} + {DAY} AS stop FROM s, range(0, 100) r(win) WHERE win <= floor((b - a - {DAY}) / {DAY / 2})),
  c AS (SELECT w.client_id, win, event_type AS l, count(*) AS k FROM w JOIN epochs e ON e.client_id = w.client_id AND e.t >= start AND e.t < stop GROUP BY ALL),
  g AS (SELECT client_id, win, sum(k)::BIGINT AS n, coalesce(sum(k) FILTER (WHERE l <> 'error'), 0) / sum(k) AS coverage, coalesce(max(k) FILTER (WHERE l <> 'error'), 0) / sum(k) AS purity,
    first(l ORDER BY k DESC, l) FILTER (WHERE l <> 'error') AS lab FROM c GROUP BY client_id, win)
  SELECT client_id, win, n, round(coverage, 6) AS coverage, round(purity, 6) AS purity, CASE WHEN coverage >= 0.6 AND purity >= 0.5 THEN lab END AS label FROM g""",
)
def label_gate_windows(spark, d):
    e = epochs(spark, d)
    w = joins.sliding_windows(e, "client_id", "t", DAY, DAY / 2)
    met = joins.range_join(w, e, "client_id", F.col("start"), F.col("stop"), "t", DAY)
    return rounded(joins.label_gate(met, ["client_id", "win"], "event_type", ["click", "purchase", "signup", "view"], 0.6, 0.5))


@query(
    "range_join_context",
    f"""WITH {EPOCHS_SQL} SELECT a.event_id, count(*) AS n, round(avg(b.value), 6) AS mean, round(max(b.t) - min(b.t), 3) AS span FROM epochs a JOIN epochs b ON a.client_id = b.client_id AND b.t >= a.t - 86400 AND b.t < a.t GROUP BY a.event_id""",
)
def range_join_context(spark, d):
    e = epochs(spark, d)
    left = e.select("client_id", "event_id", F.col("t").alias("end"))
    met = joins.range_join(left, e.select("client_id", "t", "value"), "client_id", F.col("end") - DAY, F.col("end"), "t", DAY)
    return met.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("t") - F.min("t"), 3).alias("span"))


@query(
    "complete_bins_containment",
    f"""WITH {EPOCHS_SQL}, n AS (SELECT *, lead(t) OVER (PARTITION BY client_id ORDER BY t, event_id) AS t_next FROM epochs)
  SELECT a.event_id, count(*) AS bins, round(sum(b.value), 6) AS total FROM epochs a JOIN n b ON a.client_id = b.client_id AND b.t >= a.t - 172800 AND b.t <= a.t AND b.t_next <= a.t AND b.t_next > b.t GROUP BY a.event_id""",
)
def complete_bins_containment(spark, d):
    e = epochs(spark, d)
    left = e.select("client_id", F.col("event_id").alias("epoch_id"), F.col("t").alias("end"))
    met = joins.complete_bins(e.select("client_id", "event_id", "t", "value"), left, "client_id", ["t", "event_id"], "t", F.col("end") - 2 * DAY, F.col("end"), 2 * DAY)
    return met.groupBy(F.col("epoch_id").alias("event_id")).agg(F.count(F.lit(1)).alias("bins"), F.round(F.sum("value"), 6).alias("total"))


RUNS_SQL = f"""{EPOCHS_SQL}, dt AS (SELECT *, t - lag(t) OVER (PARTITION BY client_id ORDER BY t, event_id) AS dt FROM epochs),
  st AS (SELECT *, coalesce(quantile_cont(dt, 0.5) OVER (PARTITION BY client_id), 1.0) AS step FROM dt),
  runs AS (SELECT *, (sum(CASE WHEN dt > 1.75 * step THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY t, event_id))::INT AS run FROM st)"""


def _runs(spark, d):
    return windows.contiguous_runs(epochs(spark, d), "client_id", "t", "event_id")


@query("contiguous_runs", f"WITH {RUNS_SQL} SELECT client_id, run, count(*) AS n, round(min(t), 3) AS first, round(max(t), 3) AS last, round(any_value(step), 3) AS step FROM runs GROUP BY client_id, run")
def contiguous_runs(spark, d):
    return _runs(spark, d).groupBy("client_id", "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 3).alias("first"), F.round(F.max("t"), 3).alias("last"), F.round(F.first("step"), 3).alias("step"))


def _frame_sql(kind: str, w: int) -> str:
    a, b = windows.frame(kind, w)
    return f"(PARTITION BY client_id, run ORDER BY t, event_id ROWS BETWEEN {-a} PRECEDING AND {b} FOLLOWING)"


for _kind in ("centered", "trailing", "forward"):

    def _rolling(spark, d, kind=_kind):
        out = windows.rolling(_runs(spark, d), ["client_id", "run"], ["t", "event_id"], "value", [3, 4, 12], kind)
        return rounded(out.select("event_id", *[c for c in out.columns if c.startswith(f"value_{kind}")]))

    query(
        f"rolling_{_kind}",
        f"WITH {RUNS_SQL} SELECT event_id, "
        + ", ".join(f"round(avg(value) OVER {_frame_sql(_kind, w)}, 6) AS value_{_kind}_mean_{w}, round(stddev_pop(value) OVER {_frame_sql(_kind, w)}, 6) AS value_{_kind}_std_{w}" for w in (3, 4, 12))
        + " FROM runs",
    )(_rolling)

SCALE_SQL = "CASE WHEN count(value) OVER c >= 4 THEN greatest((quantile_cont(value, 0.75) OVER c - quantile_cont(value, 0.25) OVER c) / 1.349, stddev_pop(value) OVER c * 0.05, 1e-6) ELSE 1.0 END"


@query(
    "context_features",
    f"""WITH {RUNS_SQL}, s AS (SELECT *, quantile_cont(value, 0.5) OVER c AS med, {SCALE_SQL} AS scl FROM runs WINDOW c AS (PARTITION BY client_id)),
  f AS (SELECT *, avg(value) OVER {_frame_sql('centered', 6)} AS cm, stddev_pop(value) OVER {_frame_sql('centered', 6)} AS cs, avg(value) OVER {_frame_sql('trailing', 6)} AS bm, avg(value) OVER {_frame_sql('forward', 6)} AS fm FROM s)
  SELECT event_id, round((cm - med) / scl, 6) AS value_cm_6, round(cs / scl, 6) AS value_cs_6, round((value - cm) / scl, 6) AS value_dev_6, round((bm - med) / scl, 6) AS value_bm_6,
    round((fm - med) / scl, 6) AS value_fm_6, round((fm - bm) / scl, 6) AS value_asym_6 FROM f""",
)
def context_features(spark, d):
    out = windows.context_features(_runs(spark, d), "client_id", ["t", "event_id"], "value", [6])
    return rounded(out.select("event_id", *[c for c in out.columns if c.startswith("value_")]))


@query(
    "subject_z_pct",
    f"""WITH {EPOCHS_SQL} SELECT event_id, round((value - quantile_cont(value, 0.5) OVER c) / {SCALE_SQL}, 6) AS value_z,
  round((rank() OVER (PARTITION BY client_id ORDER BY value) + (count(*) OVER (PARTITION BY client_id, value) - 1) / 2.0) / count(value) OVER c - 0.5, 6) AS value_pct FROM epochs WINDOW c AS (PARTITION BY client_id)""",
)
def subject_z_pct(spark, d):
    return rounded(windows.subject_ranks(epochs(spark, d), "client_id", "value").select("event_id", "value_z", "value_pct"))


ACTIVITY_SQL = f"{EPOCHS_SQL}, act AS (SELECT *, greatest(value - quantile_cont(value, 0.5) OVER (PARTITION BY client_id), 0.0) AS activity FROM epochs)"


@query(
    "since_last_move",
    f"""WITH {ACTIVITY_SQL}, b AS (SELECT *, CASE WHEN count(*) OVER c > 3 THEN quantile_cont(activity, 0.75) OVER c END AS thr FROM act WINDOW c AS (PARTITION BY client_id))
  SELECT event_id, round(avg(activity) OVER o, 9) AS activity_so_far, round(least(coalesce((t - last(CASE WHEN activity >= thr THEN t END IGNORE NULLS) OVER o) / 60, 999), 999), 6) AS minutes_still
  FROM b WINDOW o AS (PARTITION BY client_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)""",
)
def since_last_move(spark, d):
    out = windows.since_movement(windows.activity(epochs(spark, d), "client_id", "value"), "client_id", "t", "event_id")
    return out.select("event_id", F.round("activity_so_far", 9).alias("activity_so_far"), F.round("minutes_still", 6).alias("minutes_still"))


@query(
    "gap_interpolation",
    f"""WITH {EPOCHS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY t, event_id) AS i FROM epochs),
  k AS (SELECT *, last(gappy IGNORE NULLS) OVER p AS v0, first(gappy IGNORE NULLS) OVER f AS v1, last(CASE WHEN gappy IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, first(CASE WHEN gappy IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1
    FROM i WINDOW p AS (PARTITION BY client_id ORDER BY i ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY client_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, round(coalesce(v0 + (v1 - v0) * (i - i0) / CASE WHEN i1 > i0 THEN i1 - i0 ELSE 1 END, v0, v1), 6) AS gappy_filled FROM k""",
)
def gap_interpolation(spark, d):
    return rounded(windows.interpolate(epochs(spark, d), "client_id", ["t", "event_id"], "gappy").select("event_id", "gappy_filled"))


@query(
    "elapsed_retrospective",
    f"""WITH {ACTIVITY_SQL}, f AS (SELECT *, min(t) OVER c AS a, max(t) OVER c AS b, (t - min(t) OVER c) / greatest(max(t) OVER c - min(t) OVER c, 1e-9) AS frac FROM act WINDOW c AS (PARTITION BY client_id))
  SELECT event_id, round((t - a) / 60, 6) AS elapsed_min, round(ln(1 + (t - a) / 60), 6) AS elapsed_log, round(frac, 6) AS frac, round((b - t) / 60, 6) AS remaining_min, round(cos(frac * 6.283185307179586), 6) AS frac_cos,
    round(sin(frac * 6.283185307179586), 6) + 0.0 AS frac_sin, round(sum(activity) OVER (PARTITION BY client_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) / greatest(sum(activity) OVER (PARTITION BY client_id), 1e-9), 6) AS activity_passed FROM f""",
)
def elapsed_retrospective(spark, d):
    rows = windows.activity(epochs(spark, d), "client_id", "value")
    out = windows.retrospective(windows.elapsed(rows, "client_id", "t"), "client_id", "t", "event_id")
    return rounded(out.select("event_id", "elapsed_min", "elapsed_log", "frac", "remaining_min", "frac_cos", "frac_sin", "activity_passed"))
