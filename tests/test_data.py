import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import cli
from tidewater.operators import validate
from tidewater.plans import data

SMALL = {"context_scales": {"SLEEP": (4, 12), "WESAD": (2,)}, "context_base": {"SLEEP": ("acc_watch_mag_mean", "hr_epoch_mean", "gone"), "WESAD": ("eda_wrist_mean",)}}


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    root, g = tmp_path_factory.mktemp("raw"), np.random.default_rng(0)
    for kind in ("labels", "motion", "heart_rate", "steps"):
        (root / "sleep" / kind).mkdir(parents=True)
    for k in range(2):
        t = np.arange(0, 2700, 0.5)
        (root / "sleep/labels" / f"{k}_labeled_sleep.txt").write_text("\n".join(f"{30 * i} {2 * ((i // 12 + k) % 2)}" for i in range(90)))
        (root / "sleep/motion" / f"{k}_acceleration.txt").write_text("\n".join(f"{x} {g.normal():.4f} {g.normal():.4f} 1.0" for x in t))
        (root / "sleep/heart_rate" / f"{k}_heartrate.txt").write_text("\n".join(f"{x},{60 + g.normal():.2f}" for x in range(0, 2700, 5)))
    (root / "sleep/steps/0_steps.txt").write_text("\n".join(f"{x} {x % 7}" for x in range(0, 2700, 60)))
    n = 300
    for s in ("S2", "S3"):
        (root / "wesad" / s).mkdir(parents=True)
        label = np.ones(700 * n, dtype=int)
        label[700 * 100 : 700 * 200] = 2
        wrist = {"ACC": g.normal(size=(32 * n, 3)), "BVP": np.sin(2 * np.pi * 1.2 * np.arange(64 * n) / 64), "EDA": g.normal(size=4 * n), "TEMP": g.normal(size=4 * n)}
        (root / "wesad" / s / f"{s}.pkl").write_bytes(pickle.dumps({"label": label, "signal": {"wrist": wrist, "chest": {"TEMP": g.normal(size=700 * 60)}}}))
    return root


def test_recordings_become_a_frame_with_context(spark, recordings, tmp_path):
    c = data.data_config(f"{recordings}/wesad", f"{recordings}/sleep", wesad_subjects=("S2", "S3"), sensor_profile="wrist", cache_dir=str(tmp_path), context_time_mode="retrospective", **SMALL)
    frame, manifest = data.load_data(spark, c)
    assert {r["client_id"]: r["count"] for r in frame.groupBy("client_id").count().collect()} == {k: v for k, v in manifest["extraction_log"].items()}
    assert set(manifest["extraction_log"]) == {"SLEEP_0", "SLEEP_1", "WESAD_S2", "WESAD_S3"} and len(manifest["sources"]) == 9
    assert manifest["context"]["per_dataset"]["SLEEP"]["base_columns"] == ["acc_watch_mag_mean", "hr_epoch_mean"]
    look = {r["dataset"]: r["m"] for r in frame.groupBy("dataset").agg(F.max("declared_lookahead_s").alias("m")).collect()}
    assert look == {"SLEEP": 180.0, "WESAD": 60.0}  # the median step of the stress recordings is 60 s
    with pytest.raises(ValueError, match="lookahead_over_bound"):
        validate.check(frame, 0.0)
    again, same = data.load_data(spark, c)
    assert same == manifest and again.count() == frame.count()

    # one recording by hand
    own = frame.filter("client_id = 'SLEEP_0'").toPandas().sort_values("label_start")
    x = own["hr_epoch_mean"].to_numpy()
    q = np.percentile(x, [25, 50, 75])
    scale = max((q[2] - q[0]) / 1.349, x.std() * 0.05, 1e-6)
    i = 40
    assert own["ctx_hr_epoch_mean_bm4"].iloc[i] == pytest.approx((x[i - 3 : i + 1].mean() - q[1]) / scale)
    assert own["ctx_hr_epoch_mean_fm12"].iloc[i] == pytest.approx((x[i : i + 12].mean() - q[1]) / scale)
    assert own["ctx_hr_epoch_mean_cm4"].iloc[i] == pytest.approx((x[i - 2 : i + 2].mean() - q[1]) / scale)
    assert own["ctx_hr_epoch_mean_z"].iloc[i] == pytest.approx((x[i] - q[1]) / scale)
    assert own["ctx_hr_epoch_mean_pct"].iloc[i] == pytest.approx((x <= x[i]).mean() - 0.5)
    t = own["label_start"].to_numpy()
    assert own["time_elapsed_min"].iloc[i] == pytest.approx((t[i] - t[0]) / 60) and own["time_r_elapsed_frac"].iloc[-1] == pytest.approx(1.0)
    a = np.maximum(own["acc_watch_mag_mean"] - own["acc_watch_mag_mean"].median(), 0).to_numpy()
    assert own["time_mean_activity_so_far"].iloc[i] == pytest.approx(a[: i + 1].mean()) and own["time_r_cum_activity_frac"].iloc[i] == pytest.approx(a[: i + 1].sum() / a.sum())
    stress = frame.filter("client_id = 'WESAD_S2'")
    assert stress.filter("y = 1").count() > 0 and stress.select("ppg_wrist_pulse_rate_median").first()[0] == pytest.approx(72, abs=1.5)
    assert "ctx_eda_wrist_mean_fm2" not in frame.columns or stress.filter("ctx_eda_wrist_mean_fm2 is not null").count() == 0


def test_missing_recordings_are_told(spark, recordings, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing synthetic"):
        data.load_data(spark, data.data_config(cache_dir=str(tmp_path)))
    with pytest.raises(FileNotFoundError, match="S9"):
        data.load_data(spark, data.data_config(f"{recordings}/wesad", wesad_subjects=("S2", "S9"), cache_dir=str(tmp_path)))
    frame, manifest = data.load_data(spark, data.data_config(), make_synthetic=True)
    assert manifest["synthetic"] and frame.count() == manifest["rows"]


def test_command_line_names_recordings_and_settings():
    a = cli.parser().parse_args("run --out x --wesad-dir w --sleep-dir s --datasets SLEEP --rounds 2 --byte-budget 900 --hidden 4 --context-time-mode causal --sensor-profile wrist".split())
    assert (a.wesad_dir, a.sleep_dir, a.datasets, a.rounds, a.byte_budget, a.hidden) == ("w", "s", ["SLEEP"], 2, 900, 4)


def test_public_names():
    import tidewater

    assert all(hasattr(tidewater, name) for name in tidewater.__all__)
