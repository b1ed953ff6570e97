import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import model, personalize, sketch
from tidewater.plans import loso
from tidewater.sources import store, synthetic


def test_gradient_is_the_numerical_one():
    g, net = np.random.default_rng(0), model.Net(4, 3)
    theta, x, y = g.standard_normal(net.size) * 0.3, g.standard_normal((20, 4)), g.integers(0, 2, 20).astype(float)
    cw, anchor = np.array([0.7, 1.4]), g.standard_normal(net.size)
    f = lambda t: net.loss(t, x, y, cw, anchor, 0.01, 0.1)
    grad = f(theta)[1]
    for i in range(net.size):
        e = np.zeros(net.size)
        e[i] = 1e-5
        assert grad[i] == pytest.approx((f(theta + e)[0] - f(theta - e)[0]) / 2e-5, abs=2e-6)


def test_network_starts_at_logit_zero_and_support_masks_inputs():
    net = model.Net(3, 2)
    assert not net.logits(net.start(1), np.ones((2, 3))).any()
    assert net.support([True, False, True]).tolist() == [True, False, True, True, True, True, False, False, True, True, True, True, True, True]


def test_training_keeps_no_state_and_clips():
    net, s = model.Net(2, 2), model.Settings(clip_norm=0.1, lr=1.0)
    x, y, on = np.random.default_rng(1).standard_normal((30, 2)), np.arange(30) % 2, np.ones(net.size, bool)
    a = model.train_local(net, net.start(0), x, y, on, np.ones(2), s, 1, "a")
    assert np.array_equal(a[0], model.train_local(net, net.start(0), x, y, on, np.ones(2), s, 1, "a")[0])
    assert np.linalg.norm(a[0]) <= 0.1 + 1e-12


def test_geometric_median_resists_an_outlier():
    points = np.vstack([np.random.default_rng(0).normal(1, 0.01, (9, 3)), [[100.0, 100, 100]]])
    centre, ok, steps = sketch.geometric_median(points, np.ones(10))
    assert ok and steps <= 60 and abs(centre - 1).max() < 0.05


def test_screen_flags_the_opposed_client(spark):
    g = np.random.default_rng(5)
    base = g.standard_normal(64)
    rows = [(1, f"c{i}", (base + 0.2 * g.standard_normal(64)).tolist()) for i in range(6)] + [(1, "evil", (-5 * base).tolist())]
    out = {r["client"]: r for r in sketch.robust_screen(spark.createDataFrame(rows, "round int, client string, v array<double>"), "round", "client", "v").collect()}
    assert [c for c, r in out.items() if r["flagged"]] == ["evil"] and out["evil"]["weight"] == 0.1 and out["c0"]["reason"] == "clean"


def test_screen_by_plain_loops():
    """Each client against the converged median of the others, one by one."""
    g = np.random.default_rng(8)
    x = g.standard_normal(12) + 0.5 * g.standard_normal((9, 12))
    x[2] *= 40.0  # too large
    x[3] *= 0.01  # small updates are no reason
    x[4] = -x[4]
    got = sketch.screened(x, block=4)
    unit, logs = x / np.linalg.norm(x, axis=1, keepdims=True), np.log(np.linalg.norm(x, axis=1))
    spread = lambda v, floor: max(1.4826 * np.median(np.abs(v - np.median(v))), floor)
    for j in range(9):
        others = [k for k in range(9) if k != j]
        centre, there, _ = sketch.geometric_median(unit[others], np.ones(8))
        centre = centre / np.linalg.norm(centre)
        peers = unit[others] @ centre
        z = (np.median(peers) - unit[j] @ centre) / spread(peers, 0.1)
        n = (logs[j] - np.median(logs[others])) / spread(logs[others], 0.25)
        assert there and got["cosine"][j] == pytest.approx(unit[j] @ centre, abs=1e-5)
        assert got["z_cosine"][j] == pytest.approx(z, abs=1e-4) and got["z_norm"][j] == pytest.approx(n, abs=1e-9)
    assert np.flatnonzero(got["flagged"]).tolist() == [2, 4]


def test_clients_without_consensus_pass_unscreened(spark):
    corners = [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0], [1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]]
    out = sketch.screened(np.array(corners * 4))
    assert set(out["reason"]) <= {"no_consensus", "median_not_converged"} and not out["screened"].any() and (out["weight"] == 1).all()
    rows = spark.createDataFrame([(1, str(i), v) for i, v in enumerate(corners[:3])], "round int, client string, v array<double>")
    assert {r["reason"] for r in sketch.robust_screen(rows, "round", "client", "v").collect()} == {"warmup"}


def test_support_normalised_mean(spark):
    rows = [(1, 0, 2.0, 1.0, True), (1, 1, 0.0, 1.0, False), (1, 0, 4.0, 1.0, True), (1, 1, 6.0, 1.0, True)]
    got = sketch.aggregate_updates(spark.createDataFrame(rows, "r int, coord int, x double, weight double, support boolean"), "r")
    assert {r["coord"]: r["update"] for r in got.collect()} == {0: 3.0, 1: 6.0}


def test_forged_sketches_are_excluded_and_rounds_go_on(spark):
    f = synthetic.fixture(spark, 6, 40).filter("dataset = 'WESAD'").select("client_id", F.array("acc_f0", "hr_f2", "eda_f4").alias("x"), "y")
    net, state = model.run_rounds(f, model.Settings(rounds=2, clients_per_round=6), model.Scenario("sketch_forgery", 0.3))
    for e in state.events:
        assert (e["excluded"] == "inconsistent_sketch") == e["malicious"]
    assert [x["status"] for x in state.logs] == ["applied", "applied"]
    again = model.run_rounds(f, model.Settings(rounds=2, clients_per_round=6), model.Scenario("sketch_forgery", 0.3), state=state)[1]
    assert len(again.logs) == 2  # a finished run is not run again


def test_personal_bias():
    z, y = np.zeros(40), (np.arange(40) % 4 > 0).astype(float)
    b = personalize.fit_bias(z, y, 0.0)
    assert b == pytest.approx(np.log(3), abs=1e-6)
    # summed loss and half a ridge: 10 rows short of half pull against 5 b
    ridged = personalize.fit_bias(z, y, 5.0)
    assert 40 / (1 + np.exp(-ridged)) - 30 + 5 * ridged == pytest.approx(0, abs=1e-9)
    assert personalize.shrunk_bias(z, y, 0.0) == pytest.approx(b * 40 / 55)
    assert personalize.bias_helps(z, y, 0.0)[0] and not personalize.bias_helps(z[:7], y[:7], 0.0)[0]


def test_fold_artifact_reproduces_its_predictions(spark, tmp_path):
    f = synthetic.fixture(spark, 6, 40).filter("dataset = 'SLEEP'")
    ledger = loso.run_loso(spark, f, str(tmp_path), model.Settings(rounds=1, clients_per_round=4), folds=1)
    assert [x["status"] for x in ledger] == ["completed"]
    key = ledger[0]["run_dir"]
    saved = spark.read.parquet(f"{tmp_path}/predictions/run_key={key}")
    again = loso.Predictor.load(f"{tmp_path}/artifacts/{key}.json").predict(f.filter(F.col("client_id") == ledger[0]["client_id"]), loso.KEEP)
    a, b = (sorted((r["label_start"], round(r["p"], 9), r["prediction"]) for r in x.collect()) for x in (saved, again))
    assert a == b
    assert "1 of 1 jobs completed" in loso.summarize(spark, str(tmp_path))
    traffic = spark.read.parquet(f"{tmp_path}/communication").collect()
    sent = spark.read.parquet(f"{tmp_path}/rounds").agg(F.sum("uplink_bytes")).first()[0]
    assert [(r["dataset"], r["scenario"], r["runs"], r["uplink_bytes"]) for r in traffic] == [("SLEEP", "clean", 1, float(sent))]
    assert {r["arm"] for r in spark.read.parquet(f"{tmp_path}/personalization_summary").collect()} <= {"shared", "personalised"}
    assert spark.read.parquet(f"{tmp_path}/predictions").filter("p_raw between 0 and 1").count() == 40


def test_json_store(tmp_path):
    store.write_json(tmp_path / "a.json", {"x": float("nan"), "y": np.arange(2)})
    assert (tmp_path / "a.json").read_text().replace("\n", "").replace(" ", "") == '{"x":null,"y":[0,1]}'
