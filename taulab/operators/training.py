"""Federated training of a small autoencoder: every client's local epoch is one grouped task, the driver averages weights.

Per round only weights (a few thousand numbers per client) and losses come to the driver; feature rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taulab.constants import CONVERGENCE

Weights = list[np.ndarray]


@dataclass(frozen=True)
class Network:
    """Encoder widths; the decoder mirrors them and its last layer is linear."""

    inputs: int
    hidden: tuple[int, ...] = (80, 40, 20)

    @property
    def widths(self) -> tuple[int, ...]:
        return (self.inputs, *self.hidden, *self.hidden[-2::-1], self.inputs)

    def start(self, seed: int) -> Weights:
        rng, w = np.random.default_rng(seed), []
        for a, b in zip(self.widths, self.widths[1:]):
            bound = 1 / np.sqrt(a)
            w += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        return w


def forward(w: Weights, x: np.ndarray) -> list[np.ndarray]:
    """The values of all layers; hidden ones are rectified."""
    values = [x]
    for k in range(0, len(w), 2):
        z = values[-1] @ w[k] + w[k + 1]
        values.append(np.maximum(z, 0) if k < len(w) - 2 else z)
    return values


def errors(w: Weights, x: np.ndarray) -> np.ndarray:
    """Mean squared residual of each row, in single precision as score files keep it."""
    return ((forward(w, x)[-1] - x) ** 2).mean(axis=1).astype(np.float32).astype(np.float64) if len(x) else np.zeros(0)


def gradients(w: Weights, x: np.ndarray) -> tuple[float, Weights]:
    values = forward(w, x)
    d = values[-1] - x
    loss, g = float((d**2).mean()), [np.zeros(0)] * len(w)
    d = 2 * d / d.size
    for k in range(len(w) - 2, -1, -2):
        g[k], g[k + 1] = values[k // 2].T @ d, d.sum(axis=0)
        if k:
            d = (d @ w[k].T) * (values[k // 2] > 0)
    return loss, g


def local_epochs(w: Weights, x: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> tuple[Weights, float]:
    """Adam over shuffled batches; the mean loss of the last epoch."""
    rng = np.random.default_rng(seed)
    w = [a.copy() for a in w]
    m, v, t, loss = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, float("nan")
    for _ in range(epochs):
        order, seen = rng.permutation(len(x)), []
        for s in range(0, len(x), batch):
            part, t = x[order[s : s + batch]], t + 1
            one, g = gradients(w, part)
            seen.append((one, len(part)))
            for k in range(len(w)):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        loss = float(np.average([a for a, _ in seen], weights=[b for _, b in seen]))
    return w, loss


def average(parts: list[tuple[str, int, Weights]]) -> Weights:
    """Weighted by rows, in order of client ids, so that sums don't depend on arrival."""
    parts = sorted(parts, key=lambda p: p[0])
    total = sum(n for _, n, _ in parts)
    return [sum(n * w[k] for _, n, w in parts) / total for k in range(len(parts[0][2]))]


@dataclass
class Monitor:
    """Stops when the last window's mean loss has hardly moved from the previous one's."""

    rounds_initial: int = CONVERGENCE["rounds_initial"]
    rounds_max: int = CONVERGENCE["rounds_max"]
    threshold: float = CONVERGENCE["relative_threshold"]
    window: int = CONVERGENCE["window"]
    losses: list[float] = field(default_factory=list)

    def record(self, loss: float) -> bool:
        if not np.isfinite(loss):
            raise ValueError("a round's loss is not finite")
        self.losses.append(loss)
        done, k = len(self.losses), self.window
        if done >= self.rounds_max:
            return True
        if done < max(self.rounds_initial, 2 * k):
            return False
        last, before = np.mean(self.losses[-k:]), np.mean(self.losses[-2 * k : -k])
        return bool(before < 1e-12 or abs(last - before) / before < self.threshold)


def train(rows: DataFrame, net: Network, seed: int, monitor: Monitor | None = None, batch: int = 64, rate: float = 1e-3) -> tuple[Weights, list[float]]:
    """rows (client_id, split in train/cal, features) -> the averaged weights and the weighted calibration loss of each round."""
    monitor = monitor or Monitor()
    w = net.start(seed)
    data = rows.where("split IN ('train', 'cal')").select("client_id", "split", F.col("features").cast("array<double>").alias("features"))
    schema = "client_id string, n long, loss double, weights array<array<double>>"
    sc = rows.sparkSession.sparkContext
    while True:
        sent, number = sc.broadcast(w), len(monitor.losses)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            x = {s: np.array(g["features"].tolist(), float) for s, g in pdf.groupby("split")}
            client = pdf["client_id"].iloc[0]
            new, _ = local_epochs(sent.value, x["train"], 1, batch, rate, (seed ^ sum(client.encode())) + 1000 * number)
            return pd.DataFrame({"client_id": [client], "n": [len(x["train"])], "loss": [float(errors(new, x["cal"]).mean())], "weights": [[a.ravel().tolist() for a in new]]})

        got = data.groupBy("client_id").applyInPandas(one, schema).collect()
        sent.unpersist()
        parts = [(r.client_id, r.n, [np.array(a).reshape(b.shape) for a, b in zip(r.weights, w)]) for r in got]
        w = average(parts)
        if monitor.record(sum(r.loss * r.n for r in got) / sum(r.n for r in got)):
            return w, monitor.losses


def score(rows: DataFrame, w: Weights, features: str = "features") -> DataFrame:
    """rows plus ``score``: reconstruction errors in Arrow batches with the weights broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array(s.tolist(), float).reshape(len(s), -1)
            yield pd.Series(errors(sent.value, x)) if len(s) else pd.Series([], dtype=float)

    return rows.withColumn("score", of(F.col(features).cast("array<double>")))
