import random

from tidewater.operators import joins


def test_overlapping_by_brute_force_and_without_broadcast(spark):
    """Short, empty, very long and turned intervals; cut rows are shuffled, as the planner takes them for fewer than they are."""
    rng, rows = random.Random(1), []
    for i in range(120):
        lo = rng.uniform(0, 1e5)
        rows.append((f"k{i % 3}", i, lo, lo + rng.choice([0.0, 5.0, 300.0, 4e4, -200.0, 1e9 if i == 7 else 60.0])))
    frame = spark.createDataFrame([*rows, ("k0", 120, None, 5.0)], "key string, id long, lo double, hi double")
    met = joins.overlapping(frame.filter("id % 2 = 0"), frame.filter("id % 2 = 1"), "key")
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    got = sorted((r[0], r[1]) for r in met.select("a.id", "b.id").collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] % 2 == 0 and b[1] % 2 == 1 and a[0] == b[0] and a[2] < b[3] and a[3] > b[2])
    assert got == want
