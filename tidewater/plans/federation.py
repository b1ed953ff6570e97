"""Queries over embeddings as client updates (cohorts by label), and federated rounds over events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.exprs import l2_clip, named_int, norm
from ..operators import codec, model, sketch
from .frames import epochs, rounded, table

QUERIES, ORACLES = {}, {}
DIM, BUCKETS, SEED, CLIP = 64, 16, 7, 1.5


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _h(n: int, *parts: str) -> str:
    named = " || ':' || ".join(parts)
    return f"(('0x' || substr(sha256({named}), 1, 8))::BIGINT % {n})"


UPDATES_SQL = f"""upd AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * (0.5 + {_h(1000, "'scale'", 'vec_id::VARCHAR')} / 500.0)) AS v FROM embeddings),
  long AS (SELECT vec_id, label, unnest(range({DIM}))::INT AS coord, unnest(v) AS x FROM upd),
  ht AS (SELECT i::INT AS coord, {_h(BUCKETS, "'bucket'", f"'{SEED}'", 'i::VARCHAR')}::INT AS bucket, CASE WHEN {_h(2, "'sign'", f"'{SEED}'", 'i::VARCHAR')} = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM range({DIM}) r(i)),
  sk AS (SELECT vec_id, bucket, sum(sign * x) AS s FROM long JOIN ht USING (coord) GROUP BY vec_id, bucket)"""


def updates(spark, d):
    """Embeddings scaled by a hashed factor from 0.5 to 2.5, as all have unit norm."""
    scale = 0.5 + named_int(1000, "scale", F.col("vec_id")) / 500.0
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))


def _long(u, *keys):
    return u.select(*keys, F.posexplode("v").alias("coord", "x"))


@query("countsketch", f"WITH {UPDATES_SQL} SELECT vec_id, bucket, round(s, 6) AS s FROM sk")
def countsketch(spark, d):
    return rounded(sketch.sketch(updates(spark, d), sketch.hash_table(spark, DIM, BUCKETS, SEED), ["vec_id"], "v"))


@query("sketch_operator_norm", f"WITH {UPDATES_SQL} SELECT round(sqrt(max(n)), 6) AS opnorm FROM (SELECT count(*) AS n FROM ht GROUP BY bucket)")
def sketch_operator_norm(spark, d):
    return rounded(sketch.operator_norm(sketch.hash_table(spark, DIM, BUCKETS, SEED)))


@query(
    "sketch_audit",
    f"""WITH {UPDATES_SQL}, o AS (SELECT sqrt(max(n)) AS opnorm FROM (SELECT count(*) AS n FROM ht GROUP BY bucket)), decl AS (SELECT vec_id, bucket, CASE WHEN vec_id % 10 = 0 THEN -2.5 * s ELSE s::FLOAT::DOUBLE END AS b, s AS a FROM sk),
  r AS (SELECT vec_id, sqrt(sum((a - b) * (a - b))) AS residual, sqrt(sum(b * b)) AS size FROM decl GROUP BY vec_id), t AS (SELECT *, greatest(8 * {sketch.EPS32} * {CLIP} * sqrt({BUCKETS}) * opnorm, 1e-9) AS tol FROM r, o)
  SELECT vec_id, round(size, 6) AS size, CASE WHEN residual > tol THEN 'inconsistent_sketch' WHEN size > opnorm * {CLIP} * 1.001 THEN 'oversized_sketch' END AS reason FROM t""",
)
def sketch_audit(spark, d):
    ht = sketch.hash_table(spark, DIM, BUCKETS, SEED)
    own = sketch.sketch(updates(spark, d), ht, ["vec_id"], "v")
    told = own.withColumn("s", F.when(F.col("vec_id") % 10 == 0, -2.5 * F.col("s")).otherwise(F.col("s").cast("float").cast("double")))
    return rounded(sketch.audit(own, told, ht, ["vec_id"], BUCKETS, CLIP).select("vec_id", "size", "reason"))


@query("sketch_nullspace", f"""WITH {UPDATES_SQL} SELECT i::INT AS bucket, 0.0::DOUBLE AS s FROM range({BUCKETS}) r(i) WHERE i IN (SELECT bucket FROM ht)""")
def sketch_nullspace(spark, d):
    """The sketch of a null vector: zero in each bucket."""
    ht = sketch.hash_table(spark, DIM, BUCKETS, SEED)
    met = sketch.null_vectors(ht, SEED).join(ht, "coord")
    return met.groupBy("bucket").agg((F.round(F.sum(F.col("sign") * F.col("v")), 6) + 0.0).alias("s"))


SCREEN_STEPS = 5


@query(
    "loo_cosine_screen",
    f"""WITH RECURSIVE {UPDATES_SQL}, n AS (SELECT label, vec_id, sqrt(sum(x * x)) AS n FROM long GROUP BY label, vec_id), u AS (SELECT label, vec_id, coord, x / greatest(n, 1e-12) AS u FROM long JOIN n USING (label, vec_id)),
  it AS (SELECT 0 AS k, label, vec_id AS j, coord, (sum(u) OVER (PARTITION BY label, coord) - u) / (count(*) OVER (PARTITION BY label, coord) - 1) AS c FROM u
    UNION ALL SELECT k + 1, label, j, coord, sum(w * u) / sum(w) FROM (SELECT it.k, it.label, it.j, it.coord, u.u, 1 / greatest(sqrt(sum((u.u - c) * (u.u - c)) OVER (PARTITION BY it.label, it.j, u.vec_id)), 1e-12) AS w
      FROM it JOIN u ON u.label = it.label AND u.coord = it.coord AND u.vec_id <> it.j WHERE k < {SCREEN_STEPS}) GROUP BY k, label, j, coord),
  cen AS (SELECT label, j, coord, c, sqrt(sum(c * c) OVER (PARTITION BY label, j)) AS consensus FROM it WHERE k = {SCREEN_STEPS}),
  cs AS (SELECT cen.label, j, u.vec_id, any_value(consensus) AS consensus, sum(u.u * c) / greatest(any_value(consensus), 1e-12) AS cosine FROM cen JOIN u USING (label, coord) GROUP BY cen.label, j, u.vec_id),
  own AS (SELECT * FROM cs WHERE j = vec_id), cm AS (SELECT label, j, quantile_cont(cosine, 0.5) AS med FROM cs WHERE j <> vec_id GROUP BY label, j), cd AS (SELECT label, j, any_value(med) AS med, quantile_cont(abs(cosine - med), 0.5) AS mad FROM cs JOIN cm USING (label, j) WHERE j <> vec_id GROUP BY label, j),
  lp AS (SELECT a.label, a.vec_id AS j, ln(greatest(b.n, 1e-12)) AS x, ln(greatest(a.n, 1e-12)) AS mine FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id), lm AS (SELECT label, j, any_value(mine) AS mine, quantile_cont(x, 0.5) AS med FROM lp GROUP BY label, j),
  ld AS (SELECT label, j, any_value(lm.mine) AS mine, any_value(med) AS med, quantile_cont(abs(x - med), 0.5) AS mad FROM lp JOIN lm USING (label, j) GROUP BY label, j),
  z AS (SELECT o.label, o.vec_id, o.cosine, o.consensus, cd.med - o.cosine AS gap, (cd.med - o.cosine) / greatest(1.4826 * cd.mad, 0.1) AS z_cosine, ld.mine - ld.med AS over, (ld.mine - ld.med) / greatest(1.4826 * ld.mad, 0.25) AS z_norm FROM own o JOIN cd USING (label, j) JOIN ld USING (label, j)),
  f AS (SELECT *, consensus >= 0.1 AS screened, consensus >= 0.1 AND (cosine < -0.25 OR (z_cosine > 4.5 AND gap > 0.55) OR (z_norm > 4.5 AND over > 1.25)) AS flagged FROM z)
  SELECT label, vec_id, CASE WHEN screened THEN round(cosine, 6) END AS cosine, CASE WHEN screened THEN round(z_cosine, 6) END AS z_cosine, CASE WHEN screened THEN round(z_norm, 6) END AS z_norm, round(consensus, 6) AS consensus, screened, flagged,
    CASE WHEN NOT screened THEN 'no_consensus' WHEN flagged THEN 'flagged' ELSE 'clean' END AS reason, CASE WHEN flagged THEN 0.1 ELSE 1.0 END::DOUBLE AS weight FROM f""",
)
def loo_cosine_screen(spark, d):
    """The screen with medians after a fixed number of steps, which SQL can take as well."""
    return rounded(sketch.robust_screen(updates(spark, d), "label", "vec_id", "v", steps=SCREEN_STEPS))


@query("robust_screen")
def robust_screen(spark, d):
    """The screen with converged medians: an iteration's result, so rows only."""
    return rounded(sketch.robust_screen(updates(spark, d), "label", "vec_id", "v").select("label", "vec_id", "cosine", "flagged", "reason", "weight", "screened"), 4)


STEPS = 5


@query(
    "geometric_median_k",
    f"""WITH RECURSIVE {UPDATES_SQL}, it AS (SELECT 0 AS k, label, coord, avg(x) AS c FROM long GROUP BY label, coord
    UNION ALL SELECT k + 1, label, coord, sum(w * x) / sum(w) FROM (SELECT k, label, coord, x, 1 / greatest(sqrt(sum((x - c) * (x - c)) OVER (PARTITION BY label, vec_id)), 1e-12) AS w FROM it JOIN long USING (label, coord) WHERE k < {STEPS}) GROUP BY k, label, coord)
  SELECT label, coord, round(c, 6) AS centre FROM it WHERE k = {STEPS}""",
)
def geometric_median_k(spark, d):
    return rounded(sketch.group_medians(updates(spark, d), "label", "v", STEPS, 0.0).select("label", "coord", "centre"))


@query(
    "support_normalised_mean",
    f"""WITH {UPDATES_SQL}, w AS (SELECT *, CASE WHEN vec_id % 10 = 3 THEN 0.1 ELSE 1.0 END::DOUBLE AS weight, (vec_id + coord) % 3 <> 0 AS support FROM long)
  SELECT label, coord, round(CASE WHEN sum(weight * support::INT) > 1e-12 THEN sum(weight * CASE WHEN support THEN x ELSE 0 END) / sum(weight * support::INT) ELSE 0 END, 6) AS update FROM w GROUP BY label, coord""",
)
def support_normalised_mean(spark, d):
    on = (F.col("vec_id") + F.col("coord")) % 3 != 0
    long = _long(updates(spark, d), "vec_id", "label").select("label", "coord", F.when(on, F.col("x")).otherwise(0.0).alias("x"), F.when(F.col("vec_id") % 10 == 3, 0.1).otherwise(1.0).alias("weight"), on.alias("support"))
    return rounded(sketch.aggregate_updates(long, "label"))


@query("l2_clip", f"WITH {UPDATES_SQL} SELECT vec_id, coord, round(x * least(1.0, {CLIP} / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-30)), 6) + 0.0 AS x FROM long")
def l2_clip_query(spark, d):
    return rounded(_long(updates(spark, d).select("vec_id", l2_clip(F.col("v"), CLIP).alias("v")), "vec_id"))


@query(
    "attack_payloads",
    f"""WITH {UPDATES_SQL} SELECT vec_id, round(sum(x * CASE vec_id % 5 WHEN 1 THEN -5 WHEN 2 THEN 5 WHEN 3 THEN -2.5 WHEN 4 THEN 0 ELSE 1 END), 5) + 0.0 AS total FROM long GROUP BY vec_id""",
)
def attack_payloads(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("clean", "sign_flip", "scaled", "sketch_forgery", "free_rider")]), (F.col("vec_id") % 5 + 1).cast("int"))
    out = updates(spark, d).select("vec_id", sketch.attacked(F.col("v"), kinds).alias("v"))
    return _long(out, "vec_id").groupBy("vec_id").agg((F.round(F.sum("x"), 5) + 0.0).alias("total"))


@query(
    "quantize_mse",
    f"""WITH {UPDATES_SQL}, p AS (SELECT vec_id, max(abs(x)) AS peak FROM long GROUP BY vec_id), t AS (SELECT vec_id, i, (peak * part)::FLOAT::DOUBLE AS scale FROM p, (VALUES (0, 1.0::DOUBLE), (1, 0.85), (2, 0.7), (3, 0.55), (4, 0.4)) c(i, part)),
  e AS (SELECT vec_id, i, scale, sum(pow(x - least(greatest(round_even(x / scale * 8, 0), -8), 7) / 8 * scale, 2)) AS sse FROM long JOIN t USING (vec_id) GROUP BY vec_id, i, scale)
  SELECT vec_id, round(scale, 6) AS scale, round(sse, 6) AS sse FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sse, 12), i) AS r FROM e) WHERE r = 1""",
)
def quantize_mse(spark, d):
    return rounded(codec.quantize_long(_long(updates(spark, d), "vec_id"), ["vec_id"], 4))


@query("topk_sparse", f"WITH {UPDATES_SQL} SELECT vec_id, coord, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, coord) AS rank FROM long) WHERE rank <= 8")
def topk_sparse(spark, d):
    return codec.top_k(_long(updates(spark, d), "vec_id"), ["vec_id"], 8).select("vec_id", "coord", "rank")


@query(
    "record_cost",
    f"""SELECT n::BIGINT AS n, k::BIGINT AS k, bits, (12 + CASE WHEN k = n THEN 0 WHEN ceil(n / 8) < k * w THEN ceil(n / 8) ELSE k * w END + ceil(k * bits / 8))::BIGINT AS cost
  FROM (SELECT n, k, bits, CASE WHEN n <= 65536 THEN 2 ELSE 4 END AS w FROM (VALUES (64), (1000), (100000)) a(n), (VALUES (2), (4), (8), (16), (32)) b(bits), (VALUES (1), (20), (64), (500), (1000)) c(k) WHERE k <= n)""",
)
def record_cost(spark, d):
    grid = [(n, k, b) for n in (64, 1000, 100000) for b in codec.BITS for k in (1, 20, 64, 500, 1000) if k <= n]
    g = spark.createDataFrame(grid, "n long, k long, bits int")
    return g.withColumn("cost", codec.record_cost_column(F.col("n"), F.col("k"), F.col("bits")))


BLOCKS = [("head", 0, 16), ("body", 16, 48), ("tail", 48, 64)]


@query(
    "error_feedback_telescope",
    f"""WITH {UPDATES_SQL} SELECT vec_id, round(sum(x), 5) + 0.0 AS total, 0.0::DOUBLE AS gap FROM long GROUP BY vec_id""",
)
def error_feedback_telescope(spark, d):
    """Two rounds of feedback: what was sent and what remains add up to what was trained. total is one round's update."""
    u = updates(spark, d)
    first = u.withColumn("s", codec.encode_column(F.col("v"), 72, BLOCKS)).withColumn("left", codec.next_residual(F.col("v"), F.col("s.recon"), F.col("vec_id") % 4 != 0))
    target = F.zip_with("v", "left", lambda a, b: a + b)
    second = first.select("vec_id", "v", F.when(F.col("vec_id") % 4 != 0, F.col("s.recon")).otherwise(F.transform("v", lambda x: x * 0)).alias("sent1"), target.alias("t")).withColumn("s2", codec.encode_column(F.col("t"), 72, BLOCKS))
    end = second.withColumn("left", codec.next_residual(F.col("t"), F.col("s2.recon"), F.lit(True)))
    long = end.select("vec_id", F.posexplode(F.arrays_zip("v", "sent1", F.col("s2.recon").alias("sent2"), "left")).alias("i", "z")).select("vec_id", "z.*")
    return long.groupBy("vec_id").agg((F.round(F.sum("v"), 5) + 0.0).alias("total"), (F.round(F.max(F.abs(2 * F.col("v") - F.col("sent1") - F.col("sent2") - F.col("left"))), 6) + 0.0).alias("gap"))


@query("byte_codec_roundtrip", "SELECT vec_id, true AS decoded, true AS within_cap, true AS rejected FROM embeddings")
def byte_codec_roundtrip(spark, d):
    """Each packet decodes to what its encoder said, keeps the cap, and is rejected when its last byte is gone."""
    e = updates(spark, d).select("vec_id", codec.encode_column(F.col("v"), 120, BLOCKS).alias("e"))
    short = F.expr("substring(e.packet, 1, length(e.packet) - 1)")
    out = e.select("vec_id", "e", codec.decode_column(F.col("e.packet"), BLOCKS).alias("x"), codec.decode_column(short, BLOCKS).alias("y"))
    return out.select("vec_id", (F.col("x.vector") == F.col("e.recon")).alias("decoded"), (F.col("e.bytes") <= 120).alias("within_cap"), F.col("y.malformed").isNotNull().alias("rejected"))


@query("fleet_allocate", "SELECT * FROM (VALUES (300, 100, 100, 100), (450, 100, 249, 101), (999, 100, 350, 549), (2000, 100, 350, 600)) t(total, a, b, c)")
def fleet_allocate(spark, d):
    """Shares by hand: a stays at its cap, b and c split the rest 1 to 0.01 up to b's cap; beyond all caps nothing is dealt."""
    caps, priorities = {"a": 100, "b": 350, "c": 600}, {"a": 10.0, "b": 1.0, "c": 0.01}
    dealt = [(total, codec.allocate(caps, total, 100, priorities)) for total in (300, 450, 999, 2000)]
    return spark.createDataFrame([(total, *(got[c] for c in "abc")) for total, got in dealt], "total int, a int, b int, c int")


@query("client_sampling", f"""WITH c AS (SELECT DISTINCT label FROM embeddings) SELECT round::INT AS round, label FROM (SELECT r.round, label, row_number() OVER (PARTITION BY r.round ORDER BY sha256('participation:3:' || r.round || ':' || label)) AS k FROM c, range(1, 4) r(round)) WHERE k <= 4""")
def client_sampling(spark, d):
    return sketch.participants(table(spark, d, "embeddings").select("label").distinct(), "label", 4, 3, 3)


@query("device_tiers", """WITH c AS (SELECT DISTINCT label FROM embeddings) SELECT label, CASE (row_number() OVER (ORDER BY sha256('tier:3:' || label)) - 1) % 3 WHEN 0 THEN 800 WHEN 1 THEN 1200 ELSE 4000 END::INT AS cap FROM c""")
def device_tiers(spark, d):
    return sketch.device_caps(table(spark, d, "embeddings").select("label").distinct(), "label", [800, 1200, 4000], 3)


@query("malicious_clients", """WITH c AS (SELECT DISTINCT label FROM embeddings) SELECT label, row_number() OVER (ORDER BY sha256('malicious:3:' || label)) <= greatest(1, floor(0.3 * (SELECT count(*) FROM c))) AS malicious FROM c""")
def malicious_clients(spark, d):
    return sketch.malicious(table(spark, d, "embeddings").select("label").distinct(), "label", 0.3, 3)


def _clients(spark, d):
    e = epochs(spark, d)
    x = F.array((F.col("value") - 50) / 40, F.ln(F.col("value") + 1) / 4, F.when(F.col("gappy").isNotNull(), F.col("gappy") / 100).otherwise(F.lit(float("nan"))))
    return e.select("client_id", x.alias("x"), "y")


def _run(spark, d):
    s = model.Settings(rounds=2, clients_per_round=8, local_steps=3, hidden=4, upload_cap=700)
    return model.run_rounds(_clients(spark, d), s, model.Scenario("sketch_forgery", 0.3))[1]


@query("federated_rounds")
def federated_rounds(spark, d):
    """Two rounds under a forged-sketch attack: the clients' events. A random optimiser's result, so rows only."""
    return model.events_frame(spark, _run(spark, d))


@query("run_summary")
def run_summary(spark, d):
    state = _run(spark, d)
    return rounded(model.run_summary(model.logs_frame(spark, state), model.events_frame(spark, state)))


HIDDEN = 4


@query(
    "model_logits",
    f"""WITH e AS (SELECT vec_id, unnest(range({DIM})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), h AS (SELECT vec_id, h, tanh(sum(x * ((i + 2 * h) % 7 - 3) / 5.0) + h / 10.0) * (h + 1) / 4.0 AS t FROM e, range({HIDDEN}) r(h) GROUP BY vec_id, h),
  s AS (SELECT vec_id, sum(x * (i + 1) / 64.0) + 0.25 AS z FROM e GROUP BY vec_id) SELECT vec_id, round(any_value(z) + sum(t), 6) AS z FROM s JOIN h USING (vec_id) GROUP BY vec_id""",
)
def model_logits(spark, d):
    """Logits of fixed skip and hidden weights."""
    net, i, h = model.Net(DIM, HIDDEN), np.arange(DIM), np.arange(HIDDEN)
    theta = np.concatenate([(i + 1) / 64.0, [0.25], ((i[:, None] + 2 * h) % 7 - 3).ravel() / 5.0, h / 10.0, (h + 1) / 4.0])
    return rounded(table(spark, d, "embeddings").select("vec_id", model.logits_column(net, theta, F.col("embedding")).alias("z")))
