"""Kernel machines: rows are mapped so that inner products stand for the kernel, then a linear machine is fitted.

rbf: random Fourier features; poly: tensor sketch (count sketches of the row, multiplied in the frequency domain); sigmoid:
Nystroem map over landmark rows, the negative eigenvalues of this kernel left out. The machine minimises
|w|^2 / 2 + C sum max(0, 1 - y (w z + b))^2 by Newton steps: tasks add up gradient and Hessian over their rows, one row per task
goes on, and a system as wide as the map is solved. Machines without a third of the rows each are fitted in the same
passes; their margins on the rows they haven't seen give the logistic curve that turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.formulas import hash32
from ..session import discard, materialise

KERNELS = ("linear", "rbf", "poly", "sigmoid")
FOLDS, STEPS, GRID, PARTS = 3, 30, 2000, 16
Map = Callable[[np.ndarray], np.ndarray]


def fourier_map(d: int, size: int, gamma: float, seed: int) -> Map:
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2.0 * gamma), size=(d, size)), rng.uniform(0.0, 2.0 * np.pi, size=size)
    return lambda x: np.sqrt(2.0 / size) * np.cos(x @ w + b)


def sketch_map(d: int, size: int, gamma: float, coef0: float, degree: int, seed: int) -> Map:
    """Inner products estimate (gamma x x' + coef0)^degree without bias."""
    rng = np.random.default_rng(seed)
    extra = 1 if coef0 > 0 else 0
    slot, sign = rng.integers(0, size, (degree, d + extra)), rng.choice([-1.0, 1.0], (degree, d + extra))

    def sketched(x: np.ndarray) -> np.ndarray:
        x = np.sqrt(gamma) * x
        if extra:
            x = np.hstack([x, np.full((len(x), 1), np.sqrt(coef0))])
        out = np.ones((len(x), size // 2 + 1), complex)
        for s, t in zip(slot, sign):
            spread = np.zeros((x.shape[1], size))
            spread[np.arange(x.shape[1]), s] = t
            out *= np.fft.rfft(x @ spread, axis=1)
        return np.fft.irfft(out, n=size, axis=1)
    return sketched


def landmark_map(landmarks: np.ndarray, gamma: float, coef0: float) -> Map:
    values, vectors = np.linalg.eigh(np.tanh(gamma * landmarks @ landmarks.T + coef0))
    keep = values > 1e-9 * max(values.max(), 1e-300)
    back = vectors[:, keep] / np.sqrt(values[keep])
    return lambda x: np.tanh(gamma * x @ landmarks.T + coef0) @ back


@dataclass
class Machine:
    mapped: Map
    weights: np.ndarray
    slope: float
    offset: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights[:-1] + self.weights[-1]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(rows["v"].iloc[0]).copy()
    for v in rows["v"].iloc[1:]:
        total += np.frombuffer(v)
    return pd.DataFrame({"k": rows["k"].iloc[:1], "v": [total.tobytes()]})


def solve(table: DataFrame, mapped: Map, width: int, c: float, steps: int = STEPS) -> list[np.ndarray]:
    """Weights (bias last) of the machine over all rows, then of those without each fold. `table`: x, y (-1 or 1), fold."""
    size = width + 1
    weights = [np.zeros(size) for _ in range(FOLDS + 1)]
    moves, last = [np.zeros(size)] * (FOLDS + 1), [np.inf] * (FOLDS + 1)
    open_ = set(range(FOLDS + 1))
    for _ in range(steps):
        now = {k: weights[k] for k in open_}

        def run(batches, now=now):
            held = {k: np.zeros(1 + size + size * size) for k in now}
            for batch in batches:
                x = _matrix(batch.column(0), batch.num_rows)
                if not len(x):
                    continue
                y, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                z = np.hstack([mapped(x), np.ones((len(x), 1))])
                for k, w in now.items():
                    gap = 1.0 - y * (z @ w)
                    on = (gap > 0) & (fold != k - 1)
                    a = z[on]
                    held[k] += np.concatenate([[(gap[on] ** 2).sum()], -(y[on] * gap[on]) @ a, (a.T @ a).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                             names=["k", "v"])

        sums = {k: np.zeros(1 + size + size * size) for k in open_}
        each = table.select("x", "y", "fold").mapInArrow(run, "k int, v binary").withColumn("b", F.spark_partition_id() % PARTS)
        for r in each.groupBy("k", "b").applyInPandas(_added, "k int, v binary").collect():  # PARTS rows per machine at most
            sums[r["k"]] += np.frombuffer(r["v"])
        for k in list(open_):
            w, v = weights[k], sums[k]
            flat = np.append(np.ones(width), 1e-8)
            loss = 0.5 * (flat * w * w).sum() + c * v[0]
            if loss > last[k] + 1e-12 and np.abs(moves[k]).max() > 1e-9:  # too far: half the way back
                moves[k] = moves[k] / 2
                weights[k] = w - moves[k]
                continue
            gradient = flat * w + 2 * c * v[1: 1 + size]
            moves[k] = -np.linalg.solve(np.diag(flat) + 2 * c * v[1 + size:].reshape(size, size), gradient)
            if abs(last[k] - loss) <= 1e-9 * max(1.0, abs(loss)) or np.abs(moves[k]).max() < 1e-9:
                open_.discard(k)
                continue
            last[k] = loss
            weights[k] = w + moves[k]
        if not open_:
            break
    return weights


def _logistic(margin: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through counts at `margin`; targets are drawn in a little, so that classes that
    a margin parts entirely leave it finite."""
    p, q = positive.sum(), (n - positive).sum()
    hit = positive * (p + 1) / (p + 2) + (n - positive) / (q + 2)
    a, b = 0.0, float(np.log((p + 1) / (q + 1)))
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((n * s - hit) * margin).sum(), (n * s - hit).sum()])
        h = n * s * (1 - s)
        hess = np.array([[(h * margin * margin).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


def fit_machine(train: DataFrame, id: str, params: dict, seed: int) -> Machine:
    kernel = params.get("kernel", "rbf")
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}; one of {KERNELS}")
    table = materialise(train.select(
        vector_to_array("features").alias("x"), (2.0 * F.col("label") - 1.0).alias("y"),
        (hash32(F.col(id), seed) % FOLDS).cast("int").alias("fold"), hash32(F.col(id), f"{seed}:landmark").alias("h")), "machine")
    s = table.select(F.size("x").alias("d"), F.explode("x").alias("v")).agg(F.max("d").alias("d"), F.var_pop("v").alias("v")).first()
    d, gamma = int(s["d"] or 1), params.get("gamma", "scale")
    gamma = 1.0 / (d * (s["v"] or 1.0)) if gamma in ("scale", None) else 1.0 / d if gamma == "auto" else float(gamma)
    size, coef0 = int(params.get("n_features", 256)), float(params.get("coef0", 0.0))
    width = size
    if kernel == "linear":
        mapped, width = (lambda x: x), d
    elif kernel == "rbf":
        mapped = fourier_map(d, size, gamma, seed)
    elif kernel == "poly":
        mapped = sketch_map(d, size, gamma, coef0, int(params.get("degree", 3)), seed)
    else:
        marks = table.orderBy("h", "x").select("x").limit(size).collect()  # `size` rows at most
        mapped = landmark_map(np.array([r["x"] for r in marks]), gamma, coef0)
        width = mapped(np.array([marks[0]["x"]])).shape[1]
    weights = solve(table, mapped, width, float(params.get("C", 1.0)), int(params.get("max_iter", STEPS)))

    def unseen(batches):
        total = np.zeros((GRID + 1, 2))
        for batch in batches:
            x = _matrix(batch.column(0), batch.num_rows)
            if len(x):
                y, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                z = np.hstack([mapped(x), np.ones((len(x), 1))])
                m = (z * np.stack(weights[1:])[fold]).sum(1)
                at = np.clip(np.rint((m + 5.0) * GRID / 10.0), 0, GRID).astype(int)
                np.add.at(total, at, np.stack([y > 0, np.ones(len(y))], axis=1))
        some = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some, 0]), pa.array(total[some, 1])], names=["i", "p", "n"])

    counts = table.select("x", "y", "fold").mapInArrow(unseen, "i long, p double, n double").groupBy("i").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n")).collect()  # a row per step of the grid
    i, p, n = (np.array([r[k] for r in counts], float) for k in ("i", "p", "n"))
    slope, offset = _logistic(i * 10.0 / GRID - 5.0, p, n)
    discard(table)
    return Machine(mapped, weights[0], slope, offset)


def margin_column(machine: Machine) -> Column:
    @F.pandas_udf(DoubleType())
    def margin(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            yield pd.Series(machine.margins(np.stack(v.to_numpy())) if len(v) else np.zeros(0))
    return margin(vector_to_array("features"))
