import numpy as np

from tidewater.operators import sketch
from tidewater.plans import federation
from tidewater.plans.frames import epochs, table

from .oracle import DATA


def test_robust_screen_scores_every_update_as_single_medians_do(spark):
    got = {r["vec_id"]: (r["label"], r["cosine"]) for r in federation.robust_screen(spark, DATA).collect()}
    groups = {}
    for r in federation.updates(spark, DATA).collect():
        groups.setdefault(r["label"], []).append((r["vec_id"], np.array(r["v"])))
    assert len(got) == table(spark, DATA, "embeddings").count() == sum(map(len, groups.values()))
    for label, rows in groups.items():
        unit = np.array([v / np.linalg.norm(v) for _, v in rows])
        for i, (vec_id, _) in enumerate(rows):
            others = np.delete(unit, i, axis=0)
            c = sketch.geometric_median(others, np.ones(len(others)))[0]
            assert got[vec_id][0] == label and abs(got[vec_id][1] - unit[i] @ c / np.linalg.norm(c)) < 2e-4


def test_federated_rounds_draw_from_all_recordings(spark):
    have = {r["client_id"] for r in federation._clients(spark, DATA).select("client_id").distinct().collect()}
    assert have == {r["client_id"] for r in epochs(spark, DATA).select("client_id").distinct().collect()}
