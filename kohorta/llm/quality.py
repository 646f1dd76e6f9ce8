"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a whole text are standardised and mapped to random Fourier features, whose inner products approximate a
Gaussian kernel. Tasks sum the normal equations of their rows; the driver gets one matrix of fixed size and solves the
ridge. Scores of labelled rows that the ridge hasn't seen are binned, and pool-adjacent-violators turns the bins into a
monotone map to probabilities.

Defined cases: null and empty texts have zero statistics and a score like any other; labels that are null, or whose ids
are null, teach nothing, repeated labels of an id count once (the least); without labels every score is 0.5; texts of any
length are used whole; repeated rows get equal scores; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drawn, stored

N_STATS = 16
_ENDS = re.compile(r"[.!?,;:]$")
_KIND = np.zeros(256, np.uint8)  # of a byte: letter 1, digit 2, white space 3, sentence mark 4, capital 5, other 6
_KIND[:] = 1
for _kind, _chars in ((2, b"0123456789"), (3, b" \t\n\r\x0b\x0c"), (4, b".,;:!?'\"()-")):
    _KIND[list(_chars)] = _kind
_KIND[[c for c in range(33, 127) if _KIND[c] == 1 and not chr(c).isalpha()]] = 6
_KIND[ord("A"): ord("Z") + 1] = 5


def statistics(text: str | None) -> list[float]:
    """Fixed-length statistics of a whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    n, m = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(_KIND[raw], minlength=7) / n
    size = np.array([len(w) for w in words] or [0])
    different = set(words)
    again = sum(a == b for a, b in zip(words, words[1:])) / m
    pairs = len(set(zip(words, words[1:]))) / m
    lines = text.split("\n")
    capital = sum(len(x) > 1 and x.isupper() for x in different) / max(1, len(different))
    return [np.log1p(len(words)), float(size.mean()), float(min(50.0, size.std())), len(different) / m,
            np.log1p(len(different)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6] ** 0.5, again, pairs,
            float((size == 1).mean()), len(set(lines)) / len(lines), capital]


@dataclass
class Classifier:
    """Everything a task needs to score a text; its size doesn't depend on the data."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the random projections
    phases: np.ndarray
    ridge: np.ndarray
    at: np.ndarray  # of the calibration: raw scores, and probabilities there
    probability: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return _features(self, stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.probability), 0.0, 1.0)


def _features(m: Classifier, stats: np.ndarray) -> np.ndarray:
    z = np.clip((stats - m.mean) / m.spread, -6, 6)
    wave = np.cos(z @ m.weights + m.phases) * np.sqrt(2.0 / len(m.phases))
    return np.concatenate([wave, z, np.ones((len(z), 1))], axis=1)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centres, levels) of the non-decreasing step function nearest to the means."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, mean, weight):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _stats_of(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of `docs` without the text and those that `score` adds, and `stats`."""
    kept = [c for c in docs.columns if c not in (text_col, "stats", "score", "predicted")]

    def run(batches):
        for batch in batches:
            stats = [statistics(t) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(stats, pa.list_(pa.float64()))],
                                             names=[*kept, "stats"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    return docs.select(*kept, text_col).mapInArrow(run, ", ".join([*fields, "stats array<double>"]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        learn=None, max_rows: int = 20_000, waves: int = 128, penalty: float = 1e-3, bins: int = 400,
        seed: int = 5) -> Classifier:
    """Learn from at most `max_rows` labelled rows, those of the least hashes of their ids.

    `learn` is a condition on `_id` that labelled rows must meet. A fifth of the rows calibrates, the others fit the ridge.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y")) \
        .where("_id is not null and _y is not null")
    if learn is not None:
        known = known.where(learn)
    known = drawn(known.groupBy("_id").agg(F.min("_y").alias("_y")), ["_id"], max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")) \
        .join(F.broadcast(known), "_id")  # max_rows ids and numbers at most
    table = stored(_stats_of(rows, "_text"), "statistics")
    part = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(5))
    mean = np.zeros(N_STATS)
    spread = np.ones(N_STATS)
    sums = table.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v"), F.stddev_pop("v")).collect()
    for k, a, b in sums:
        mean[k], spread[k] = a, b if b > 1e-9 else 1.0
    rng = np.random.default_rng(seed)
    width = np.sqrt(N_STATS)  # of the kernel, in standard deviations
    m = Classifier(mean, spread, rng.normal(size=(N_STATS, waves)) / width, rng.uniform(0, 2 * np.pi, waves),
                   np.zeros(waves + N_STATS + 1), np.array([0.0]), np.array([0.5]))
    if not sums:
        return m

    def equations(batches):
        size = len(m.ridge) + 1
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = _features(m, np.array(batch.column(0).to_pylist()))
                x = np.concatenate([x, batch.column(1).to_numpy()[:, None]], axis=1)
                total += x.T @ x
        i = np.arange(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    size = len(m.ridge) + 1
    summed = table.where(part != 0).select("stats", "_y").mapInArrow(equations, "i long, v array<double>") \
        .groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(size)]).orderBy("i").collect()
    full = np.array([list(r)[1:] for r in summed])
    a, b = full[:-1, :-1], full[:-1, -1]
    n = max(1.0, a[-1, -1])
    m.ridge = np.linalg.solve(a + penalty * n * np.diag([1.0] * (len(b) - 1) + [1e-9]) + 1e-9 * np.eye(len(b)), b)

    def histogram(batches):
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(m.raw(np.array(batch.column(0).to_pylist())), -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(((raw + 0.5) / 2 * (bins - 1)).astype(np.int64)),
                                                  batch.column(1), pa.array(raw)], names=["bin", "y", "raw"])

    held = table.where(part == 0).select("stats", "_y").mapInArrow(histogram, "bin long, y double, raw double") \
        .groupBy("bin").agg(F.avg("raw"), F.avg("y"), F.count("*")).orderBy("bin").collect()
    if held:
        x, y, w = (np.array([r[k] for r in held], float) for k in (1, 2, 3))
        m.at, m.probability = isotonic(x, y, w)
    return m


def score(docs: DataFrame, model: Classifier, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` without the text, with score and predicted (1 if score >= threshold, else 0) in place of such columns."""
    table = _stats_of(docs, text_col)
    kept = [c for c in table.columns if c != "stats"]

    def run(batches):
        for batch in batches:
            stats = np.array(batch.column(len(kept)).to_pylist(), float).reshape(batch.num_rows, N_STATS)
            p = model.score(stats)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             names=[*kept, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "stats"]
    return table.mapInArrow(run, ", ".join([*fields, "score double, predicted int"]))


def accepted(docs: DataFrame, model: Classifier, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` with a score of at least `threshold`, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(-1, N_STATS)
            yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def by_id(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
