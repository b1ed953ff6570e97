import numpy as np

from tidewater.operators import validate
from tidewater.plans import extract
from tidewater.sources import nested_signals


def test_sleep_recordings_become_epochs(spark):
    t = np.arange(0, 600, 0.5)
    motion = spark.createDataFrame([("a", float(x), 0.1, 0.2, float(1.0 + 0.01 * np.sin(x))) for x in t if not 90 <= x < 118], "client_id string, t double, x double, y double, z double")
    hr = spark.createDataFrame([("a", float(x), 60.0 if x else -1.0) for x in range(0, 600, 5)], "client_id string, t double, hr double")
    steps = spark.createDataFrame([("a", float(x), 2.0) for x in range(0, 600, 60)], "client_id string, t double, n double")
    labels = spark.createDataFrame([("a", float(x), s) for x, s in zip(range(0, 600, 30), [0, 2, 4, 0] * 5, strict=True)], "client_id string, t double, stage int")
    f = extract.sleep_frame(labels, motion, hr, steps)
    rows = {r["label_start"]: r for r in f.collect()}
    assert 60.0 not in rows and 90.0 not in rows and len(rows) == 14  # stage 4 does not count, the epoch at 90 lacks motion
    assert rows[0.0]["y"] == 0 and rows[30.0]["y"] == 1
    assert rows[0.0]["hr_epoch_n"] == 5 and rows[570.0]["hr_context_n"] == 24
    # bins whole inside the last 300 s; the end of the last bin is unknown
    assert rows[570.0]["steps_complete_n"] == 4 and rows[570.0]["steps_complete_mean"] == 2.0
    assert rows[570.0]["feature_start"] == 300.0 and rows[0.0]["feature_start"] == -90.0
    inside = [0.01 * np.sin(x) for x in np.arange(30, 60, 0.5)]
    assert abs(rows[30.0]["acc_watch_a2_slope"] - np.polyfit(np.arange(60) * 0.5, inside, 1)[0]) < 1e-9
    assert extract.stage_counts(labels).first()["excluded"] == 5
    assert validate.check(f, 0.0).count() == 14


def test_stress_recordings_become_windows(spark):
    n = 130
    t = np.arange(64 * n) / 64
    nested = {"signal": {"wrist": {"ACC": np.ones((32 * n, 3)), "BVP": np.sin(2 * np.pi * 1.2 * t), "EDA": np.linspace(0, 1, 4 * 60)}}, "label": np.r_[np.ones(700 * 60, int), np.full(700 * (n - 60), 2)]}
    samples, labels = nested_signals.to_tables(spark, {"WESAD_S2": nested})
    rows = {r["label_start"]: r for r in extract.stress_frame(samples, labels).collect()}
    assert sorted(rows) == [0.0, 60.0] and (rows[0.0]["y"], rows[60.0]["y"]) == (0, 1)  # the window at 30 is half of each
    assert abs(rows[60.0]["ppg_wrist_pulse_rate_median"] - 72) < 1.5 and rows[0.0]["acc_wrist_mag_std"] < 1e-9
    assert rows[0.0]["eda_wrist_n"] == 240 and rows[60.0]["eda_wrist_n"] is None
    assert 0.9 < rows[0.0]["eda_wrist_power_0_0p05"] + rows[0.0]["eda_wrist_power_0p05_0p5"] <= 1 and rows[0.0]["acc_wrist_a0_mean"] == 1.0


def test_chest_temperature_may_be_named_in_capitals():
    rows = list(nested_signals.sample_rows("s", {"signal": {"chest": {"TEMP": [1.0, 2.0], "unknown": [1]}, "wrist": {}}}))
    assert [(r[2], r[3], r[5]) for r in rows] == [("Temp", 700.0, [1.0]), ("Temp", 700.0, [2.0])]
