import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import joins, metrics, signal, splits, stats, validate, windows
from tidewater.sources import nested_signals, synthetic, text_series
from tidewater.streaming import causal


def test_label_gate_counts_purity_over_all_labels(spark):
    df = spark.createDataFrame([(1, 0)] * 9 + [(1, 2)] + [(2, 1)] * 20, "g int, l int")
    out = {r["g"]: r for r in joins.label_gate(df, ["g"], "l", [1, 2, 3]).collect()}
    assert (out[1]["label"], out[1]["coverage"], out[1]["purity"]) == (None, 0.1, 0.1)
    assert out[2]["label"] == 1


def test_complete_bins(spark):
    s = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("a", 200.0)], "c string, t double")
    for lo, hi, want in ((-10.0, 150.0, [0.0]), (-10.0, 1000.0, [0.0, 100.0])):
        i = spark.createDataFrame([("a", lo, hi)], "c string, lo double, hi double")
        got = joins.complete_bins(s, i, "c", ["t"], "t", F.col("lo"), F.col("hi"), 50.0)
        assert sorted(r["t"] for r in got.collect()) == want


def test_metric_goldens(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.2), ("a", 1, 0.8), ("a", 1, 0.9), ("b", 0, 0.1), ("b", 0, 0.1)], "k string, y int, p double")
    ece = {r["k"]: r for r in metrics.calibration_errors(df, ["k"]).collect()}
    assert ece["a"]["probability_ece"] == pytest.approx(0.15) and ece["a"]["confidence_ece"] == pytest.approx(0.15)
    one = {r["k"]: r for r in metrics.confusion(df, ["k"]).collect()}["b"]
    assert one["degenerate"] and one["macro_f1"] == 0.5 and one["kappa"] is None
    assert {r["k"]: r["auroc"] for r in metrics.auroc_ap(df, ["k"]).collect()} == {"a": 1.0, "b": None}


def test_bootstrap_is_null_below_its_minimum(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(3)], "g string, i int, x double")
    r = stats.bootstrap_mean(df, ["g"], "i", "x", 20).first()
    assert r["ci_low"] is None and r["ci_high"] is None and r["mean"] == 1.0


def test_validation_names_what_is_broken(spark):
    f = synthetic.fixture(spark, 5, 10)
    assert validate.check(f, 0.0).count() == 100
    for bad, rule in ((f.withColumn("y", F.lit(2)), "label_not_binary"), (f.unionByName(f.limit(1)), "repeated_epoch"), (f.withColumn("feature_end", F.col("feature_end") + 1), "overshoot_undeclared"), (f.withColumn("acc_f0", F.lit(float("inf"))), "infinite_feature"), (f.limit(0), "empty"), (f.withColumn("declared_lookahead_s", F.lit(9.0)), "lookahead_over_bound")):
        with pytest.raises(ValueError, match=rule):
            validate.check(bad, 0.0)
    with pytest.raises(ValueError, match="missing columns"):
        validate.check(f.drop("y"), 0.0)


def test_splits_are_disjoint_and_shards_complete(spark):
    roles = splits.loso_roles(synthetic.fixture(spark, 6, 2).select("dataset", "client_id"))
    assert not validate.role_leakage(roles).take(1)
    assert roles.filter("role = 'test'").count() == 12
    jobs = splits.seeded_jobs(roles, [0, 1])
    parts = [splits.shard_jobs(jobs, ["dataset", "held", "seed"], k, 3) for k in range(3)]
    assert splits.merge_shards(parts, 3, ["dataset", "held", "seed"]).count() == 24
    with pytest.raises(ValueError, match="two shards"):
        splits.merge_shards([parts[0], parts[0]], 2, ["dataset", "held", "seed"])
    with pytest.raises(ValueError, match="1 of 3"):
        splits.merge_shards(parts[:1], 3, ["held"])


def test_declared_lookahead_is_what_forward_frames_reach(spark):
    df = spark.createDataFrame([(30.0, 0.0, 30.0)], "step double, feature_start double, feature_end double")
    assert windows.lookahead(df, [4, 12], True, True).first()["declared_lookahead_s"] == 330.0
    assert windows.lookahead(df, [4, 12], True, False).first()["declared_lookahead_s"] == 150.0


def test_subject_ranks_use_their_own_subject_only(spark):
    a = spark.createDataFrame([("a", float(i)) for i in range(8)], "c string, x double")
    b = a.unionByName(spark.createDataFrame([("b", 1e6)] * 9, "c string, x double"))
    want = sorted(windows.subject_ranks(a, "c", "x").select("x", "x_z", "x_pct").collect())
    assert sorted(windows.subject_ranks(b, "c", "x").filter("c = 'a'").select("x", "x_z", "x_pct").collect()) == want


def test_spectrum_finds_a_tone_and_beats():
    t = np.arange(0, 60, 1 / 64)
    x = np.array([np.sin(2 * np.pi * 1.2 * t), np.sin(2 * np.pi * 2.0 * t) + 5.0, np.full(len(t), 3.0)])
    one, two, flat = signal.channel_table(x, 64.0, "ppg")
    assert one["dominant_hz"] == pytest.approx(1.2, abs=0.13) and two["dominant_hz"] == pytest.approx(2.0, abs=0.13)
    assert one["pulse_rate_median"] == pytest.approx(72, abs=1.5) and one["interval_valid_fraction"] > 0.95
    assert one["power_0.5_8"] > 0.99 and one["interval_rmssd"] < 0.03 and "pulse_rate_median" not in flat
    f, p = signal.spectra(x[:1], 64.0)
    assert p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.02)
    passed = signal.filtered(np.ones((1, 4000)), signal.band_pass(0.5, 8.0, 64.0))
    assert abs(passed[0, -1]) < 1e-3
    middle = np.sin(2 * np.pi * 2.0 * np.arange(0, 40, 1 / 64))
    assert np.abs(signal.filtered(middle[None], signal.band_pass(0.5, 8.0, 64.0))[0, -640:]).max() == pytest.approx(1.0, abs=0.01)
    for edge in (0.5, 8.0):  # half of the power at the edges
        wave = np.sin(2 * np.pi * edge * np.arange(0, 80, 1 / 64))
        assert np.abs(signal.filtered(wave[None], signal.band_pass(0.5, 8.0, 64.0))[0, -1280:]).max() == pytest.approx(np.sqrt(0.5), abs=0.01)


def test_windows_without_features():
    bad = np.ones((2, 64))
    bad[0, 5] = np.nan
    none, some = signal.channel_table(bad, 4.0, "eda")
    assert none == {} and some["spec_entropy"] == 0.0 and some["positive_diff_mean"] == 0.0 and "dominant_hz" not in some
    assert signal.channel_table(np.ones((1, 15)), 4.0, "eda") == [{}] and signal.channel_table(np.ones((1, 99)), 4.0, "temp") == [{}]


def test_maxima_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = np.round(rng.normal(size=80), 1)
        tops = []
        for i in range(1, 79):
            j = i
            while j < 79 and x[j + 1] == x[i]:
                j += 1
            if x[i - 1] < x[i] and j < 79 and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
        kept = []
        for p in sorted(tops, key=lambda p: (-x[p], -p)):
            if all(abs(p - q) >= 4 for q in kept):
                kept.append(p)
        want = []
        for p in sorted(kept):
            lows = []
            for step in (-1, 1):
                q, low = p, x[p]
                while 0 <= q < 80 and x[q] <= x[p]:
                    low, q = min(low, x[q]), q + step
                lows.append(low)
            if x[p] - max(lows) >= 0.5:
                want.append(p)
        assert signal.maxima(x, 4, 0.5).tolist() == want


def test_text_series(spark, tmp_path):
    for kind, name, text in (("labels", "7_labeled_sleep.txt", "0 0\n30 2\n# x\nbad 1\n"), ("motion", "7_acceleration.txt", "0.5 1 2 3\n1 1 2\n"), ("heart_rate", "7_heartrate.txt", "5,60\n0,61\n")):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / name).write_text(text)
    hr = text_series.read_kind(spark, str(tmp_path), "heart_rate").orderBy("t").collect()
    assert [(r["client_id"], r["t"], r["v"]) for r in hr] == [("SLEEP_7", 0.0, [61.0]), ("SLEEP_7", 5.0, [60.0])]
    assert [r["t"] for r in text_series.read_kind(spark, str(tmp_path), "labels").orderBy("t").collect()] == [0.0, 30.0]
    motion = text_series.read_kind(spark, str(tmp_path), "motion")
    assert motion.filter("whole").count() == 1 and not text_series.require_columns(motion, ["client_id"]).take(1)
    who = text_series.subjects(spark, str(tmp_path)).first()
    assert who["missing"] == [] and not who["steps"]


def test_nested_signals(spark):
    import pickle

    nested = {"signal": {"wrist": {"ACC": np.ones((32 * 20, 3)), "EDA": np.arange(80.0)}}, "label": np.ones(5, int)}
    back = nested_signals.load_nested(pickle.dumps(nested))
    samples, labels = nested_signals.to_tables(spark, {"S2": back})
    got = nested_signals.window_samples(samples, 10.0, 5.0).groupBy("channel", "win").count().collect()
    assert sorted(map(tuple, got)) == [("ACC", 0, 320), ("ACC", 1, 320), ("ACC", 2, 320), ("EDA", 0, 40), ("EDA", 1, 40), ("EDA", 2, 40)]
    assert labels.count() == 5
    with pytest.raises(pickle.UnpicklingError):
        nested_signals.load_nested(pickle.dumps(print))


def test_streaming_state_equals_batch(spark, tmp_path):
    rows = [("a", i, 60.0 * i, float(i % 4), 3.0) for i in range(12)]
    schema = "client_id string, event_id long, t double, value double, bound double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = causal.causal_features(stream).writeStream.format("memory").queryName("causal").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("causal").orderBy("event_id").collect()
    assert [r["minutes_still"] for r in got[:8]] == [999.0, 999.0, 999.0, 0.0, 1.0, 2.0, 3.0, 0.0]
    assert got[-1]["mean_so_far"] == pytest.approx(1.5)
