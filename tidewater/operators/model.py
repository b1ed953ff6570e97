"""A residual network on tabular features, its local training, and federated rounds as Spark jobs.

z = X skip + bias + tanh(X W1 + b1) W2, with W2 zero at first: it starts as a linear model at logit zero. Parameters
are one flat vector with named blocks. A round trains the sampled clients on executors (one grouped-map job), brings
their packets to the server, and applies what survives audit and screening.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codec, sketch


@dataclass(frozen=True)
class Net:
    inputs: int
    hidden: int

    @property
    def blocks(self) -> list[tuple[str, int, int]]:
        sizes = (("skip", self.inputs), ("bias", 1), ("W1", self.inputs * self.hidden), ("b1", self.hidden), ("W2", self.hidden))
        out, at = [], 0
        for name, n in sizes:
            out.append((name, at, at + n))
            at += n
        return out

    @property
    def size(self) -> int:
        return self.blocks[-1][2]

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        s, b, w1, b1, w2 = (theta[lo:hi] for _, lo, hi in self.blocks)
        return [s, b, w1.reshape(self.inputs, self.hidden), b1, w2]

    def start(self, seed: int) -> np.ndarray:
        theta = np.zeros(self.size)
        _, lo, hi = self.blocks[2]
        theta[lo:hi] = rng("init", seed).standard_normal(hi - lo) / np.sqrt(max(self.inputs, 1))
        return theta

    def logits(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        s, b, w1, b1, w2 = self.split(theta)
        return x @ s + b + np.tanh(x @ w1 + b1) @ w2

    def support(self, available: np.ndarray) -> np.ndarray:
        """Which parameters a client with these inputs can train: skip and W1 rows of its inputs, all others."""
        on = np.asarray(available, bool)
        return np.concatenate([on, [True], np.repeat(on, self.hidden), np.ones(2 * self.hidden, bool)])

    def loss(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray, class_weight: np.ndarray, anchor: np.ndarray | None = None, l2: float = 0.0, prox: float = 0.0) -> tuple[float, np.ndarray]:
        """Mean logistic loss by class weight with L2 and proximal terms, and its gradient."""
        s, b, w1, b1, w2 = self.split(theta)
        h = np.tanh(x @ w1 + b1)
        z = x @ s + b + h @ w2
        w = class_weight[y.astype(int)]
        mass = max(w.sum(), 1e-300)
        value = float(w @ (np.logaddexp(0, z) - y * z) / mass)
        e = w * (1 / (1 + np.exp(-z)) - y) / mass
        back = np.outer(e, w2) * (1 - h * h)
        grad = np.concatenate([x.T @ e, [e.sum()], (x.T @ back).ravel(), back.sum(0), h.T @ e])
        value += 0.5 * l2 * float(theta @ theta)
        grad = grad + l2 * theta
        if anchor is not None and prox:
            value += 0.5 * prox * float((theta - anchor) @ (theta - anchor))
            grad = grad + prox * (theta - anchor)
        return value, grad


def rng(*parts) -> np.random.Generator:
    """A generator named by its parts, the same on every machine."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big"))


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    local_steps: int = 5
    batch: int = 128
    hidden: int = 8
    lr: float = 0.01
    server_lr: float = 1.0
    momentum: float = 0.5
    l2: float = 1e-4
    prox: float = 0.0
    clip_norm: float = 1.0
    clients_per_round: int = 10
    sketch_dim: int = 64
    upload_cap: int = 1200
    codec: str = "auto"
    screen: bool = True
    audit: bool = True
    error_feedback: bool = True
    screen_min: int = 5
    warm_up: int = 0
    eval_every: int = 1
    seed: int = 0

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Scenario:
    attack: str = "clean"
    malicious_fraction: float = 0.0
    tiers: tuple[int, ...] = ()
    fleet_fraction: float = 1.0


PRESETS = {"smoke": Settings(), "pilot": Settings(rounds=50, local_steps=10, hidden=48, upload_cap=8000, sketch_dim=128), "study": Settings(rounds=100, local_steps=10, hidden=48, upload_cap=8000, sketch_dim=128)}


def preset(name: str, **changes) -> Settings:
    return replace(PRESETS[name], **changes)


def train_local(net: Net, theta: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray, class_weight: np.ndarray, s: Settings, *names) -> tuple[np.ndarray, float]:
    """The clipped change of local_steps Adam steps from theta on seeded batches, and the mean loss. No state is kept."""
    gen, now, m, v, losses = rng("batch", s.seed, *names), theta.copy(), np.zeros_like(theta), np.zeros_like(theta), []
    for step in range(1, s.local_steps + 1):
        rows = gen.choice(len(y), min(s.batch, len(y)), replace=False)
        loss, g = net.loss(now, x[rows], y[rows], class_weight, theta, s.l2, s.prox)
        losses.append(loss)
        g = np.where(mask, g, 0.0)
        size = np.linalg.norm(g)
        g = g * min(1.0, 10.0 / max(size, 1e-12))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        now -= s.lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    delta = np.where(mask, now - theta, 0.0)
    return delta * min(1.0, s.clip_norm / max(np.linalg.norm(delta), 1e-12)), loss


def _sketcher(dim: int, buckets: int, *names) -> tuple[np.ndarray, np.ndarray, float]:
    gen = rng("sketch", *names)
    bucket, sign = gen.integers(0, buckets, dim), gen.choice([-1.0, 1.0], dim)
    return bucket, sign, float(np.sqrt(np.bincount(bucket, minlength=buckets).max()))


def _sketch(v: np.ndarray, bucket: np.ndarray, sign: np.ndarray, buckets: int) -> np.ndarray:
    return np.bincount(bucket, sign * v, buckets)


def attack_vector(kind: str, v: np.ndarray, bucket: np.ndarray, sign: np.ndarray, *names) -> np.ndarray:
    scale = {"sign_flip": -5.0, "scaled": 5.0, "sketch_forgery": -2.5, "free_rider": 0.0}.get(kind)
    if scale is not None:
        return v * scale
    noise = rng("attack", *names).standard_normal(len(v))
    if kind == "gaussian":
        return noise / np.linalg.norm(noise) * np.linalg.norm(v)
    if kind == "nullspace":
        load = np.bincount(bucket)
        noise -= sign * (np.bincount(bucket, sign * noise) / np.maximum(load, 1))[bucket]
        return v + 5 * np.linalg.norm(v) * noise / max(np.linalg.norm(noise), 1e-12)
    return v


@dataclass
class State:
    theta: np.ndarray
    momentum: np.ndarray
    residuals: dict[str, np.ndarray] = field(default_factory=dict)
    logs: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    best: tuple[float, np.ndarray, int] | None = None


LOG_SCHEMA = "round int, participants int, status string, uplink_bytes long, sketch_bytes long, downlink_to_kept long, audit_excluded int, flagged int, infeasible int, relative_distortion double, norm_delta double, val_macro_f1 double, val_nll double"
EVENT_SCHEMA = "round int, client_id string, malicious boolean, physical_cap int, allocated_bytes int, excluded string, attack string, screened boolean, flagged boolean, weight double, screen_reason string"


def _worker(sent):
    """What a sampled client does in a round: train, clip, add its residual, encode, sketch."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        net, theta, s, residuals, room, bad, attack, class_weight, r = sent.value
        c = part["client_id"].iloc[0]
        x = np.array(part["x"].tolist(), dtype=float)
        seen = np.isfinite(x)
        x, y = np.where(seen, x, 0.0), part["y"].to_numpy(float)
        evil = c in bad
        if evil and attack == "label_flip":
            y = 1 - y
        mask = net.support(seen.any(0))
        delta, loss = train_local(net, theta, x, y, mask, class_weight, s, r, c)
        bucket, sign, _ = _sketcher(net.size, s.sketch_dim, s.seed, r)
        honest = _sketch(delta, bucket, sign, s.sketch_dim)
        if evil:
            delta = attack_vector(attack, delta, bucket, sign, s.seed, r, c)
        target = delta + (residuals[c] if s.error_feedback and residuals.get(c) is not None else 0.0)
        target = np.where(mask, target, 0.0)
        try:
            data, back, error = codec.encode(target, room[c] - codec.overhead(s.sketch_dim), net.blocks, s.codec)
        except codec.Infeasible:
            return pd.DataFrame([(c, None, target.tolist(), mask.tolist(), 0.0, 0.0, loss)], columns=COLUMNS)
        told = honest if evil and attack == "sketch_forgery" else _sketch(back, bucket, sign, s.sketch_dim)
        sealed = codec.envelope(r, 0, data, told, error, float(target @ target))
        return pd.DataFrame([(c, sealed, target.tolist(), mask.tolist(), error, float(target @ target), loss)], columns=COLUMNS)

    return work


def run_rounds(clients: DataFrame, s: Settings, scenario: Scenario = Scenario(), validate=None, state: State | None = None, checkpoint=None) -> tuple[Net, State]:
    """clients: client_id, x array<double>, y, a row per epoch with the same inputs; rows of a client train together.

    The server holds the model, the sampled clients' packets and residuals of their size; rows never leave executors.
    validate(net, theta) gives a score (the participants' mean macro-F1) and a loss; the round of the highest score is kept. A state from a checkpoint resumes after its last
    round; checkpoint(state) is called each round.
    """
    spark = clients.sparkSession
    facts = clients.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.max(F.size("x")).alias("d")).orderBy("client_id").collect()  # a row per client
    ids, inputs = [r["client_id"] for r in facts], max(r["d"] for r in facts)
    net = Net(inputs, s.hidden)
    mass = np.array([sum((r["n"] - r["pos"]) / r["n"] for r in facts), sum(r["pos"] / r["n"] for r in facts)])
    class_weight = np.sqrt(mass.sum() / (2 * np.maximum(mass, 1e-9)))
    class_weight /= class_weight @ mass / mass.sum()
    order = lambda *names: sorted(ids, key=lambda c: hashlib.sha256(":".join(map(str, (*names, c))).encode()).hexdigest())
    bad = set(order("malicious", s.seed)[: max(1, int(scenario.malicious_fraction * len(ids)))]) if scenario.malicious_fraction > 0 else set()
    caps = {c: (scenario.tiers[i % len(scenario.tiers)] if scenario.tiers else s.upload_cap) for i, c in enumerate(order("tier", s.seed))}
    extra = codec.overhead(s.sketch_dim)
    state = state or State(net.start(s.seed), np.zeros(net.size))
    down = len(codec.encode(np.zeros(net.size), 1 << 30, net.blocks, "dense")[0])

    for r in range(len(state.logs) + 1, s.rounds + 1):
        chosen = order("participation", s.seed, r)[: min(s.clients_per_round, len(ids))]
        total = int(sum(caps[c] for c in chosen) * scenario.fleet_fraction)
        room = codec.allocate({c: caps[c] for c in chosen}, total, min(extra + 64, *(caps[c] for c in chosen)))
        bucket, sign, opnorm = _sketcher(net.size, s.sketch_dim, s.seed, r)
        sent = spark.sparkContext.broadcast((net, state.theta, s, {c: state.residuals.get(c) for c in chosen}, room, bad, scenario.attack, class_weight, r))

        got = clients.filter(F.col("client_id").isin(*chosen)).groupBy("client_id").applyInPandas(_worker(sent), "client_id string, envelope binary, target array<double>, mask array<boolean>, error double, energy double, loss double").orderBy("client_id").collect()
        payload, declared, target, mask, events, size = {}, {}, {}, {}, {}, 0
        energy = error = 0.0
        for row in got:
            c = row["client_id"]
            target[c], mask[c] = np.array(row["target"]), np.array(row["mask"])
            events[c] = {"round": r, "client_id": c, "malicious": c in bad, "physical_cap": caps[c], "allocated_bytes": room[c], "excluded": "", "attack": scenario.attack if c in bad else "clean", "screened": False, "flagged": False, "weight": 0.0, "screen_reason": ""}
            if row["envelope"] is None:
                events[c]["excluded"] = "infeasible_budget"
                continue
            assert len(row["envelope"]) <= room[c]
            _, _, data, declared[c], _, _ = codec.open_envelope(bytes(row["envelope"]))
            payload[c] = codec.decode(data, net.blocks)
            size += len(row["envelope"])
            energy, error = energy + row["energy"], error + row["error"]
        if s.audit:
            tol = max(8 * sketch.EPS32 * opnorm * s.clip_norm * np.sqrt(s.sketch_dim), 1e-9)
            for c in list(payload):
                off = np.linalg.norm(_sketch(payload[c], bucket, sign, s.sketch_dim) - declared[c])
                if off > tol * max(1.0, np.linalg.norm(declared[c])):
                    events[c]["excluded"] = "inconsistent_sketch"
                elif np.linalg.norm(declared[c]) > opnorm * s.clip_norm * 1.001 * (3.0 if s.error_feedback else 1.0):
                    events[c]["excluded"] = "oversized_sketch"
        kept = [c for c in sorted(payload) if not events[c]["excluded"]]
        weights = dict.fromkeys(kept, 1.0)
        if s.screen and len(kept) >= s.screen_min and r > s.warm_up:
            frame = spark.createDataFrame([(1, c, declared[c].tolist()) for c in kept], "round int, client_id string, v array<double>")
            for x in sketch.robust_screen(frame, "round", "client_id", "v", s.screen_min).collect():  # a row per sampled client
                weights[x["client_id"]] = x["weight"]
                events[x["client_id"]] |= {"screened": x["screened"], "flagged": x["flagged"], "screen_reason": x["reason"] or ""}
        for c in kept:
            events[c]["weight"] = weights[c]
        moved = np.zeros(net.size)
        if kept:
            num = sum(weights[c] * payload[c] for c in kept)
            den = sum(weights[c] * mask[c] for c in kept)
            moved = np.where(den > 1e-12, num / np.maximum(den, 1e-12), 0.0)
        state.momentum = s.momentum * state.momentum + moved if kept else np.zeros(net.size)
        state.theta = state.theta + s.server_lr * state.momentum
        if not np.isfinite(state.theta).all():
            raise FloatingPointError(f"round {r}: parameters not finite")
        for c in target:  # applied updates leave what was not sent, all others leave everything
            state.residuals[c] = target[c] - payload[c] if c in kept else target[c]
        score = value = None
        if validate and (r % s.eval_every == 0 or r == s.rounds):
            score, value = map(float, validate(net, state.theta))
            if state.best is None or score > state.best[0] + 1e-12:
                state.best = (score, state.theta.copy(), r)
        state.events += list(events.values())
        state.logs.append({
            "round": r, "participants": len(chosen), "status": "applied" if kept else "no_feasible_clients" if not payload else "all_audit_excluded", "uplink_bytes": size, "sketch_bytes": 4 * s.sketch_dim * len(payload),
            "downlink_to_kept": down * len(kept), "audit_excluded": len(payload) - len(kept), "flagged": sum(e["flagged"] for e in events.values()), "infeasible": sum(e["excluded"] == "infeasible_budget" for e in events.values()),
            "relative_distortion": error / energy if energy else 0.0, "norm_delta": float(np.linalg.norm(moved)), "val_macro_f1": score, "val_nll": value,
        })
        if checkpoint:
            checkpoint(state)
    return net, state


COLUMNS = ["client_id", "envelope", "target", "mask", "error", "energy", "loss"]


def logs_frame(spark, state: State) -> DataFrame:
    names = [x.split()[0] for x in LOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(x[n] for n in names) for x in state.logs], LOG_SCHEMA)


def events_frame(spark, state: State) -> DataFrame:
    names = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(x[n] for n in names) for x in state.events], EVENT_SCHEMA)


def run_summary(logs: DataFrame, events: DataFrame) -> DataFrame:
    """One row: bytes, counts and rates of a run."""
    c = F.col
    of = lambda x, cond: F.avg(F.when(cond, x.cast("double")))
    a = logs.agg(F.sum("uplink_bytes").alias("uplink_bytes"), F.sum("sketch_bytes").alias("sketch_bytes"), F.sum("downlink_to_kept").alias("downlink_to_kept"), F.avg("relative_distortion").alias("relative_distortion"), F.sum("audit_excluded").alias("audit_excluded"), F.count_if(c("status") == "applied").alias("applied_rounds"))
    b = events.agg(
        F.count(F.lit(1)).alias("client_rounds"), of(c("flagged"), c("screened") & c("malicious")).alias("screen_tpr"), of(c("flagged"), c("screened") & ~c("malicious")).alias("screen_fpr"),
        F.avg(c("screened").cast("double")).alias("screen_coverage"), of(c("weight"), c("malicious")).alias("malicious_weight"), F.count_if(c("excluded") == "infeasible_budget").alias("infeasible"),
    )
    return a.crossJoin(b)  # one row each


def logits_column(net: Net, theta: np.ndarray, x):
    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(net.logits(theta, np.array(rows.tolist(), dtype=float))) if len(rows) else pd.Series([], dtype=float)

    return run(x)
