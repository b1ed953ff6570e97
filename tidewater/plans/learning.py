"""Queries over labels, splits, weights, metrics and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding, joins, metrics, preprocess, splits, validate, windows
from .frames import EPOCHS_SQL, SCORED_SQL, epochs, rounded, scored, table
from .signals import RUNS_SQL

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


FRAME_SQL = f"""{RUNS_SQL}, frame AS (SELECT dataset, client_id, event_id, y, value AS acc_value, gappy AS hr_value, t AS label_start, t + 30 AS label_end, t - step * 5 AS feature_start, t + 30 + CASE WHEN event_id % 50 = 0 THEN 900 ELSE 0 END AS feature_end,
  CASE WHEN event_id % 40 = 0 THEN 700.0 ELSE 0.0 END AS look FROM runs)"""


def frame(spark, d):
    runs = windows.contiguous_runs(epochs(spark, d), "client_id", "t", "event_id")
    return runs.select(
        "dataset", "client_id", "event_id", "y", F.col("value").alias("acc_value"), F.col("gappy").alias("hr_value"), F.col("t").alias("label_start"), (F.col("t") + 30).alias("label_end"),
        (F.col("t") - F.col("step") * 5).alias("feature_start"), (F.col("t") + 30 + F.when(F.col("event_id") % 50 == 0, 900).otherwise(0)).alias("feature_end"),
        F.when(F.col("event_id") % 40 == 0, 700.0).otherwise(0.0).alias("declared_lookahead_s"),
    )


@query(
    "validate_violations",
    f"""WITH {FRAME_SQL}, r AS (SELECT count_if(client_id IS NULL) AS null_client, count_if(y NOT IN (0, 1)) AS label_not_binary, count_if(feature_start >= feature_end) AS feature_interval, count_if(label_start >= label_end) AS label_interval,
    count_if(look < 0) AS lookahead_invalid, count_if(look > 600 + 1e-8) AS lookahead_over_bound, count_if(feature_end - label_end > look + 1e-8) AS overshoot_undeclared, 0::BIGINT AS infinite_feature, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS empty FROM frame),
  d AS (SELECT count(*) AS k FROM (SELECT 1 FROM frame GROUP BY client_id, label_start HAVING count(*) > 1)), m AS (SELECT count(*) AS k FROM (SELECT 1 FROM frame GROUP BY client_id HAVING count(DISTINCT dataset) > 1))
  SELECT * FROM (UNPIVOT r ON COLUMNS(*) INTO NAME rule VALUE violations) UNION ALL SELECT 'repeated_epoch', k FROM d UNION ALL SELECT 'client_in_datasets', k FROM m""",
)
def validate_violations(spark, d):
    return validate.violations(frame(spark, d), 600.0, ["acc_value", "hr_value"])


@query("declared_lookahead", f"WITH {FRAME_SQL} SELECT f.event_id, round(f.feature_start - step * 11, 3) AS feature_start, round(f.feature_end + step * 11, 3) AS feature_end, round(step * 11, 3) AS declared_lookahead_s FROM frame f JOIN runs USING (event_id)")
def declared_lookahead(spark, d):
    runs = windows.contiguous_runs(epochs(spark, d), "client_id", "t", "event_id").select("event_id", "step")
    out = windows.lookahead(frame(spark, d).join(runs, "event_id"), [4, 12], True, True)
    return rounded(out.select("event_id", "feature_start", "feature_end", "declared_lookahead_s"), 3)


ROLES_SQL = """clients AS (SELECT c_mktsegment AS dataset, 'C' || c_custkey::VARCHAR AS client_id FROM customer),
  n AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS n FROM clients), ok AS (SELECT * FROM n WHERE n >= 5),
  picked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sha256('fold:0:' || client_id)) AS k FROM ok),
  pairs AS (SELECT h.dataset, h.client_id AS held, c.client_id, h.n, row_number() OVER (PARTITION BY h.dataset, h.client_id ORDER BY c.client_id = h.client_id, sha256('split:0:' || h.client_id || ':' || c.client_id)) AS r
    FROM picked h JOIN ok c USING (dataset) WHERE h.k <= 3),
  roles AS (SELECT dataset, held, client_id, CASE WHEN client_id = held THEN 'test' WHEN r <= nv THEN 'val' WHEN r <= 2 * nv THEN 'cal' ELSE 'fit' END AS role
    FROM (SELECT *, least(3, greatest(1, floor((n - 4) / 2))) AS nv FROM pairs))"""


def roles(spark, d):
    clients = table(spark, d, "customer").select(F.col("c_mktsegment").alias("dataset"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("client_id"))
    return splits.loso_roles(clients, 0, 3, 3)


@query("loso_roles", f"WITH {ROLES_SQL} SELECT * FROM roles")
def loso_roles(spark, d):
    return roles(spark, d)


@query(
    "partition_leakage",
    f"""WITH {ROLES_SQL}, bad AS (SELECT dataset, held, client_id, role FROM roles WHERE NOT (role = 'cal' AND held < 'C5') UNION ALL SELECT dataset, held, held, 'fit' FROM roles WHERE role = 'test')
  SELECT held, 'client_in_roles' AS problem, client_id AS detail FROM bad GROUP BY held, client_id HAVING count(DISTINCT role) > 1
  UNION ALL SELECT h.held, 'empty_role', r.role FROM (SELECT DISTINCT held FROM bad) h, (VALUES ('fit'), ('val'), ('cal'), ('test')) r(role) WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.held = h.held AND b.role = r.role)""",
)
def partition_leakage(spark, d):
    """On roles that were spoilt on purpose: a held-out client that is also fitted on, and splits without cal."""
    good = roles(spark, d)
    leaked = good.filter("role = 'test'").select("dataset", "held", F.col("held").alias("client_id"), F.lit("fit").alias("role"))
    return validate.role_leakage(good.filter(~((F.col("role") == "cal") & (F.col("held") < "C5"))).unionByName(leaked))


@query("jobs_shard", f"WITH {ROLES_SQL}, j AS (SELECT DISTINCT dataset, held, seed FROM roles, (VALUES (1), (2), (3)) s(seed)) SELECT dataset, held, seed FROM (SELECT *, row_number() OVER (ORDER BY dataset, held, seed) - 1 AS i FROM j) WHERE i % 4 = 1")
def jobs_shard(spark, d):
    return splits.shard_jobs(splits.seeded_jobs(roles(spark, d), [1, 2, 3]), ["dataset", "held", "seed"], 1, 4)


@query(
    "role_rows",
    f"""WITH {ROLES_SQL} SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE 'C' || o_custkey::VARCHAR IN (SELECT client_id FROM roles WHERE role = 'fit' AND held = (SELECT min(held) FROM roles)) GROUP BY o_custkey""",
)
def role_rows(spark, d):
    r = roles(spark, d)
    held = r.agg(F.min("held")).first()[0]
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("dataset"))
    rows = table(spark, d, "orders").join(seg, "o_custkey").withColumn("client_id", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    return splits.role_rows(rows, r, held, "fit").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "support_query_split",
    f"""WITH {FRAME_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY label_start, event_id) AS rn, CASE WHEN count(*) OVER (PARTITION BY client_id) < 5 THEN 0 ELSE least(10, count(*) OVER (PARTITION BY client_id) // 3) END AS k FROM frame),
  e AS (SELECT *, max(CASE WHEN rn <= k THEN greatest(feature_end, label_end) END) OVER (PARTITION BY client_id) AS e FROM k)
  SELECT event_id, CASE WHEN rn <= k THEN 'support' WHEN e IS NULL OR (feature_start >= e AND label_start >= e) THEN 'query' END AS part FROM e""",
)
def support_query_split(spark, d):
    return joins.support_query(frame(spark, d), "client_id", ["label_start", "event_id"], 10).select("event_id", "part")


@query(
    "temporal_overlap",
    f"""WITH {FRAME_SQL} SELECT a.client_id, count(*) AS pairs FROM frame a JOIN frame b ON a.client_id = b.client_id AND a.feature_start < b.feature_end AND a.feature_end > b.feature_start WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1 GROUP BY a.client_id""",
)
def temporal_overlap(spark, d):
    f = frame(spark, d).select("client_id", "event_id", F.col("feature_start").alias("lo"), F.col("feature_end").alias("hi"))
    met = joins.overlapping(f.filter("event_id % 2 = 0"), f.filter("event_id % 2 = 1"), "client_id")
    return met.groupBy(F.col("a.client_id").alias("client_id")).agg(F.count(F.lit(1)).alias("pairs"))


WEIGHTS_SQL = f"{EPOCHS_SQL}, w AS (SELECT *, (1.0 / count(*) OVER (PARTITION BY client_id)) / ((SELECT count(DISTINCT client_id) FROM epochs)::DOUBLE / (SELECT count(*) FROM epochs)) AS weight FROM epochs)"


@query("subject_weights", f"WITH {WEIGHTS_SQL} SELECT event_id, round(weight, 6) AS weight FROM w")
def subject_weights(spark, d):
    return rounded(preprocess.subject_weights(epochs(spark, d), "client_id").select("event_id", "weight"))


@query(
    "class_weights",
    f"WITH {WEIGHTS_SQL}, m AS (SELECT y, sum(weight) AS mass FROM w GROUP BY y), r AS (SELECT *, pow((SELECT sum(mass) FROM m) / (2 * mass), 0.5) AS raw FROM m) SELECT y, round(mass, 6) AS mass, round(raw / ((SELECT sum(raw * mass) / sum(mass) FROM r)), 6) AS class_weight FROM r",
)
def class_weights(spark, d):
    return rounded(preprocess.class_weights(preprocess.subject_weights(epochs(spark, d), "client_id"), 0.5))


AXES = {"acc_q": "l_quantity", "acc_p": "l_extendedprice", "eda_d": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END", "eda_t": "l_tax"}


def _scaler(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("acc_q"), F.col("l_extendedprice").alias("acc_p"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")).alias("eda_d"), F.col("l_tax").alias("eda_t"))
    return preprocess.RobustScaler().fit(rows.filter("l_suppkey % 2 = 0"), list(AXES)), rows


_FIT_SQL = "x AS (SELECT l_orderkey, l_suppkey, " + ", ".join(f"{s} AS {c}" for c, s in AXES.items()) + " FROM lineitem), f AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, greatest((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.349, stddev_pop({c}) * 0.05, 1e-6) AS s_{c}" for c in AXES) + " FROM x WHERE l_suppkey % 2 = 0)"


@query(
    "robust_transform",
    f"WITH {_FIT_SQL} SELECT l_suppkey, count(*) AS n, " + ", ".join(f"round(sum(coalesce(least(greatest(({c} - m_{c}) / s_{c}, -8), 8), 0)), 8) AS z_{c}" for c in AXES) + ", round(avg((eda_d IS NULL)::INT / 2.0), 6) AS missing_eda FROM x, f GROUP BY l_suppkey",
)
def robust_transform(spark, d):
    scaler, rows = _scaler(spark, d)
    out = scaler.transform(rows, ["l_suppkey"])
    return out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(f"z_{c}"), 8).alias(f"z_{c}") for c in AXES], F.round(F.avg("missing_eda"), 6).alias("missing_eda"))


@query("available_inputs", f"WITH {_FIT_SQL} SELECT l_suppkey, " + ", ".join(f"count({c}) > 0 AS has_{c}" for c in AXES) + " FROM x GROUP BY l_suppkey")
def available_inputs(spark, d):
    scaler, rows = _scaler(spark, d)
    return scaler.available(rows, "l_suppkey")


CLIPPED_SQL = f"{SCORED_SQL}, c AS (SELECT lang, source, y, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM scored)"
_M = "coalesce(2.0 * {a} / nullif(2 * {a} + fp + fn, 0), 0)"


@query(
    "metric_suite",
    f"""WITH {CLIPPED_SQL}, k AS (SELECT lang, count_if(y = 0 AND p < 0.5) AS tn, count_if(y = 0 AND p >= 0.5) AS fp, count_if(y = 1 AND p < 0.5) AS fn, count_if(y = 1 AND p >= 0.5) AS tp, avg((p - y) * (p - y)) AS brier, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS nll FROM c GROUP BY lang),
  s AS (SELECT *, tn + fp + fn + tp AS n, (tp + tn) / (tn + fp + fn + tp) AS acc, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tn + fp + fn + tp) / (tn + fp + fn + tp) AS chance, tp + fn > 0 AND tn + fp > 0 AS two FROM k)
  SELECT lang, tn, fp, fn, tp, round(brier, 6) AS brier, round(nll, 6) AS nll, n, tp + fn AS n_class1, round((tp + fn) / n, 6) AS prevalence, NOT two AS degenerate, round({_M.format(a='tp')}, 6) AS f1_class1, round({_M.format(a='tn')}, 6) AS f1_class0,
    round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(acc, 6) AS accuracy, round(({_M.format(a='tp')} + {_M.format(a='tn')}) / 2, 6) AS macro_f1,
    round(CASE WHEN two THEN (acc - chance) / nullif(1 - chance, 0) END, 6) AS kappa, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_acc FROM s""",
)
def metric_suite(spark, d):
    return rounded(metrics.confusion(scored(spark, d), ["lang"]))


@query(
    "auroc_ap",
    f"""WITH {SCORED_SQL}, v AS (SELECT lang, p, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scored GROUP BY lang, p),
  u AS (SELECT *, sum(pos) OVER dn AS tp, sum(neg) OVER dn AS fp, sum(pos) OVER up AS fn, sum(neg) OVER up AS tn FROM v WINDOW dn AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING), up AS (PARTITION BY lang ORDER BY p ROWS UNBOUNDED PRECEDING))
  SELECT lang, round(sum(pos * (tn - neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc, round(CASE WHEN sum(neg) > 0 THEN sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) END, 6) AS ap_class1,
    round(CASE WHEN sum(pos) > 0 THEN sum(neg * tn / (tn + fn)) / nullif(sum(neg), 0) END, 6) AS ap_class0 FROM u GROUP BY lang""",
)
def auroc_ap(spark, d):
    return rounded(metrics.auroc_ap(scored(spark, d), ["lang"]))


@query(
    "calibration_ece",
    f"""WITH {CLIPPED_SQL}, k AS (SELECT lang, 'probability' AS kind, p AS x, y::DOUBLE AS hit FROM c UNION ALL SELECT lang, 'confidence', greatest(p, 1 - p), (y = (p >= 0.5)::INT)::INT::DOUBLE FROM c),
  b AS (SELECT lang, kind, least(floor(x * 10), 9) AS bin, count(*) AS n, abs(avg(x) - avg(hit)) AS gap FROM k GROUP BY ALL)
  SELECT lang, round(sum(n * gap) FILTER (kind = 'probability') / sum(n) FILTER (kind = 'probability'), 6) AS probability_ece, round(sum(n * gap) FILTER (kind = 'confidence') / sum(n) FILTER (kind = 'confidence'), 6) AS confidence_ece FROM b GROUP BY lang""",
)
def calibration_ece(spark, d):
    return rounded(metrics.calibration_errors(scored(spark, d), ["lang"]))


SCAN_SQL = f"""{SCORED_SQL}, g AS (SELECT (0.02 + 0.005 * i)::DOUBLE AS threshold FROM range(193) r(i)),
  k AS (SELECT threshold, source, count_if(y = 0 AND p < threshold) AS tn, count_if(y = 0 AND p >= threshold) AS fp, count_if(y = 1 AND p < threshold) AS fn, count_if(y = 1 AND p >= threshold) AS tp FROM scored, g GROUP BY ALL),
  scan AS (SELECT threshold, avg(({_M.format(a='tp')} + {_M.format(a='tn')}) / 2) AS score FROM k GROUP BY threshold)"""


@query("threshold_scan", f"WITH {SCAN_SQL} SELECT round(threshold, 6) AS threshold, round(score, 6) AS score FROM scan")
def threshold_scan(spark, d):
    return rounded(metrics.threshold_scan(scored(spark, d), "source"))


@query("threshold_best", f"WITH {SCAN_SQL} SELECT round(threshold, 6) AS threshold, round(score, 6) AS score FROM scan ORDER BY round(score, 12) DESC, abs(threshold - 0.5), threshold LIMIT 1")
def threshold_best(spark, d):
    return rounded(metrics.best_threshold(metrics.threshold_scan(scored(spark, d), "source")))


@query(
    "participant_summary",
    f"""WITH {SCORED_SQL}, r AS (SELECT lang AS dataset, source AS client_id, doc_id % 3 AS seed, avg(p) AS mean_p, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY ALL), e AS (SELECT dataset, client_id, avg(mean_p) AS mean_p, avg(brier) AS brier, count(DISTINCT seed) AS seeds FROM r GROUP BY ALL),
  l AS (SELECT dataset, client_id, seeds, 'mean_p' AS metric, mean_p AS x FROM e UNION ALL SELECT dataset, client_id, seeds, 'brier', brier FROM e)
  SELECT dataset, metric, count(DISTINCT client_id) AS n_subjects, count(x) AS n_valid_subjects, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.1), 6) AS p10, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum, min(seeds) AS n_seeds_min, count(x) >= 6 AS ci_reportable
  FROM l GROUP BY dataset, metric""",
)
def participant_summary(spark, d):
    runs = scored(spark, d).groupBy(F.col("lang").alias("dataset"), F.col("source").alias("client_id"), (F.col("doc_id") % 3).alias("seed")).agg(F.avg("p").alias("mean_p"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    return rounded(metrics.summary(runs, ["mean_p", "brier"]).drop("ci_low", "ci_high"))


@query("minority_lift", f"""WITH {SCORED_SQL}, v AS (SELECT lang, p, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scored GROUP BY lang, p), u AS (SELECT *, sum(pos) OVER up AS fn, sum(neg) OVER up AS tn FROM v WINDOW up AS (PARTITION BY lang ORDER BY p ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT lang, CASE WHEN sum(pos) > 0 THEN sum(neg * tn / (tn + fn)) / nullif(sum(neg), 0) END AS ap, sum(neg) / (sum(neg) + sum(pos)) AS share FROM u GROUP BY lang) SELECT lang, round(ap, 6) AS minority_ap, round(ap / nullif(share, 0), 6) AS minority_ap_lift FROM a""")
def minority_lift(spark, d):
    return rounded(metrics.minority(scored(spark, d), ["lang"], 0))


CHAIN_SQL = f"""{RUNS_SQL}, nx AS (SELECT y, lead(y) OVER (PARTITION BY client_id, run ORDER BY t, event_id) AS y2 FROM runs),
  cnt AS (SELECT a, b, 0.5 + count(nx.y) AS n FROM (VALUES (0), (1)) i(a) CROSS JOIN (VALUES (0), (1)) j(b) LEFT JOIN nx ON nx.y = a AND nx.y2 = b GROUP BY a, b),
  trans AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM cnt), prior AS (SELECT y AS a, (0.5 + count(*)) / (1 + (SELECT count(*) FROM runs)) AS p FROM runs GROUP BY y)"""


def _runs(spark, d):
    return windows.contiguous_runs(epochs(spark, d), "client_id", "t", "event_id")


@query("transition_matrix", f"WITH {CHAIN_SQL} SELECT 'transition' AS kind, a::INT AS a, b::INT AS b, round(p, 6) AS p FROM trans UNION ALL SELECT 'prior', a, NULL, round(p, 6) FROM prior")
def transition_matrix(spark, d):
    return rounded(decoding.chain_table(_runs(spark, d), ["client_id", "run"], ["t", "event_id"], "y"))


@query(
    "hmm_smooth",
    f"""WITH RECURSIVE {CHAIN_SQL}, z AS (SELECT *, least(greatest(1 / (1 + exp(-(value - 50) / 40)), 1e-6), 1 - 1e-6) AS p, row_number() OVER (PARTITION BY client_id, run ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY client_id, run) AS n FROM runs),
  k AS (SELECT (SELECT p FROM prior WHERE a = 0) AS p0, (SELECT p FROM prior WHERE a = 1) AS p1, (SELECT p FROM trans WHERE a = 0 AND b = 0) AS a00, (SELECT p FROM trans WHERE a = 0 AND b = 1) AS a01, (SELECT p FROM trans WHERE a = 1 AND b = 0) AS a10, (SELECT p FROM trans WHERE a = 1 AND b = 1) AS a11),
  o AS (SELECT z.client_id, z.run, z.i, z.n, z.event_id, (1 - z.p) / p0 AS e0, z.p / p1 AS e1 FROM z, k),
  fw AS (SELECT client_id, run, i, p0 * e0 / (p0 * e0 + p1 * e1) AS f0, p1 * e1 / (p0 * e0 + p1 * e1) AS f1 FROM o, k WHERE i = 1
    UNION ALL SELECT o.client_id, o.run, o.i, (f0 * a00 + f1 * a10) * e0 / ((f0 * a00 + f1 * a10) * e0 + (f0 * a01 + f1 * a11) * e1), (f0 * a01 + f1 * a11) * e1 / ((f0 * a00 + f1 * a10) * e0 + (f0 * a01 + f1 * a11) * e1) FROM fw JOIN o ON o.client_id = fw.client_id AND o.run = fw.run AND o.i = fw.i + 1, k),
  bw AS (SELECT client_id, run, i, 0.5::DOUBLE AS b0, 0.5::DOUBLE AS b1 FROM o WHERE i = n
    UNION ALL SELECT q.client_id, q.run, q.i - 1, (a00 * e0 * b0 + a01 * e1 * b1) / (a00 * e0 * b0 + a01 * e1 * b1 + a10 * e0 * b0 + a11 * e1 * b1), (a10 * e0 * b0 + a11 * e1 * b1) / (a00 * e0 * b0 + a01 * e1 * b1 + a10 * e0 * b0 + a11 * e1 * b1)
      FROM bw q JOIN o ON o.client_id = q.client_id AND o.run = q.run AND o.i = q.i, k WHERE q.i > 1)
  SELECT o.event_id, round(f1 * b1 / (f0 * b0 + f1 * b1), 6) AS smoothed FROM o JOIN fw USING (client_id, run, i) JOIN bw USING (client_id, run, i)""",
)
def hmm_smooth(spark, d):
    rows = _runs(spark, d).withColumn("p", 1 / (1 + F.exp(-(F.col("value") - 50) / 40)))
    chain = decoding.fit_chain(rows, ["client_id", "run"], ["t", "event_id"], "y")
    return rounded(decoding.smooth(rows, ["client_id", "run"], ["t", "event_id"], chain, 1.0).select("event_id", F.col("p_smooth").alias("smoothed")))


@query("calibrated_logits", f"WITH {SCORED_SQL} SELECT doc_id, round(1 / (1 + exp(-(1.25 * least(greatest(ln(p / (1 - p)), -30), 30) - 0.5))), 6) AS p_calibrated FROM scored")
def calibrated_logits(spark, d):
    from ..operators.calibrate import Calibration

    z = F.ln(F.col("p") / (1 - F.col("p")))
    return rounded(scored(spark, d).select("doc_id", Calibration(1.25, -0.5).probability(z).alias("p_calibrated")))


@query("calibration_fit")
def calibration_fit(spark, d):
    """Slope and shift fitted on the labelled documents, sources as participants: rows only, an optimiser's result."""
    from ..operators.calibrate import fit

    c = fit(scored(spark, d).withColumn("z", F.ln(F.col("p") / (1 - F.col("p")))), "source", "z", "y")
    return rounded(spark.createDataFrame([(c.slope, c.shift)], "slope double, shift double"), 4)


@query("personal_bias")
def personal_bias(spark, d):
    """Gated personal biases by source, with the support of its first documents: rows only, an optimiser's result."""
    from ..operators.personalize import personal_rows

    rows = scored(spark, d).select("lang", F.col("source").alias("client_id"), "doc_id", "y", F.ln(F.col("p") / (1 - F.col("p"))).alias("z"))
    part = F.when(F.expr("row_number() over (partition by client_id order by doc_id) <= least(20, count(1) over (partition by client_id) / 3)"), "support").otherwise("query")
    return rounded(personal_rows(rows.withColumn("part", part), 0.5, 0.1))


@query("frame_hash", f"WITH {EPOCHS_SQL} SELECT count(*) AS n FROM epochs")
def frame_hash(spark, d):
    """The hash itself is Spark's own, so the twin checks the number of rows."""
    return validate.frame_hash(epochs(spark, d)).select(F.col("rows").alias("n"))


@query("data_summary", f"WITH {EPOCHS_SQL} SELECT dataset, 'events' AS task, count(DISTINCT client_id) AS clients, count(*) AS epochs, round(avg(y), 6) AS positive FROM epochs GROUP BY dataset")
def data_summary(spark, d):
    return rounded(epochs(spark, d).groupBy("dataset", F.lit("events").alias("task")).agg(F.countDistinct("client_id").alias("clients"), F.count("y").alias("epochs"), F.avg("y").alias("positive")))
