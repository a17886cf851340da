"""Quality by Bradley-Terry ranking: a score learned from pairs of which one document is preferred.

The chance that i is preferred to j is logistic in w . (x_i - x_j); x are shape statistics of the text, each bent at knots.
A cutoff is a quantile of the scores; the score given out is logistic, with 0.3 at the cutoff.

Learning reads at most TRAIN_ROWS labelled documents, the first in the order of a hash of their id, or all if they are
fewer, and draws PAIRS pairs from them. Everything else covers every document and whole texts.

Defined results: null and empty texts have statistics of 0 and a score like others; labels that are null, contradict
themselves or name no document don't count; without two classes of labels every score is 0.5; equal texts get equal
scores; an empty table gives no rows. Only the named columns are used.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import sample, sigmoid

TRAIN_ROWS = 20_000
PAIRS = 100_000
KNOTS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98)
AT_CUTOFF = 0.3
SEED = 11


def shape(text: str | None) -> list[float]:
    """Statistics of a text's form, free of its language and length as far as may be."""
    data = (text or "").encode()
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    w, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    grams = list(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
    words, upper = max(1, len(w)), n[65:91].sum()
    letters = max(1, upper + n[97:123].sum() + n[128:].sum())
    marks = n[[33, 63]].sum(), n[list(b"#*$%&<>@~^\\{}[]=_")].sum(), n[124], n[48:58].sum(), n[list(b".,;:")].sum()
    lengths = np.fromiter(map(len, w), np.float64, len(w)) if w else np.zeros(1)
    return [
        np.log1p(len(w)),
        lengths.mean(),
        lengths.std(),
        upper / letters,
        *(x / words for x in marks),
        len(set(w)) / words**0.8,
        sum(map(operator.eq, w, w[1:])) / words,
        1 - len(set(grams)) / max(1, len(grams)),
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / words,
    ]


def bent(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Statistics and, for each knot, how far they are above it."""
    return np.concatenate([x, np.maximum(0, x[:, :, None] - knots[None, :, :]).reshape(len(x), -1)], axis=1)


class BradleyTerry:
    """weights of scores; cut: the raw score of the cutoff."""

    def __init__(self) -> None:
        self.knots = self.middle = self.scale = self.weights = None
        self.cut, self.steep = 0.0, 1.0

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.clip((bent(x, self.knots) - self.middle) / self.scale, -8, 8)

    def fit(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, seed: int = SEED) -> BradleyTerry:
        """Newton's method on the logistic loss of differences between rows with y = 1 and rows with y = 0."""
        rng = np.random.default_rng(seed)
        self.knots = np.quantile(x, KNOTS, axis=0).T
        raw = bent(x, self.knots)
        self.middle, self.scale = raw.mean(0), raw.std(0) + 1e-9
        f = self.features(x)
        d = f[rng.choice(np.flatnonzero(y == 1), pairs)] - f[rng.choice(np.flatnonzero(y == 0), pairs)]
        w = np.zeros(f.shape[1])
        for _ in range(12):
            p = sigmoid(d @ w)
            step = np.linalg.solve((d.T * (p * (1 - p))) @ d / pairs + l2 * np.eye(len(w)), d.T @ (p - 1) / pairs + l2 * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.cut, self.steep = self.quantile_cut(f @ w, float((y == 0).mean())), 1.0
        return self

    @staticmethod
    def quantile_cut(scores: np.ndarray, share: float) -> float:
        """The score below which a share of all lies: midway between its neighbours."""
        s = np.sort(scores)
        at = min(max(1, round(share * len(s))), len(s) - 1)
        return float(s[at - 1] + s[at]) / 2 if len(s) > 1 else float(s[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; AT_CUTOFF at the cutoff."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        return sigmoid(self.steep * (self.features(x) @ self.weights - self.cut) + np.log(AT_CUTOFF / (1 - AT_CUTOFF)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> BradleyTerry:
    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([shape(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["k", "y", "x"])

    got = sample(docs, labels, label, key, text, rows).select(F.col("_k").cast("string").alias("k"), "text", "y").mapInArrow(shapes, "k string, y int, x array<double>").toPandas()
    y = got["y"].to_numpy()
    if len(set(y.tolist()) & {0, 1}) < 2:
        return BradleyTerry()
    x = np.stack(got["x"].to_list())
    order = np.lexsort([*x.T, got["k"].to_numpy().astype(str)])
    return BradleyTerry().fit(x[order], y[order])


def scored(docs: DataFrame, model: BradleyTerry, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (long) and score (double) of each document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shape(t.as_py()) for t in b.column(1)], float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(model.score(x), 9) if len(x) else np.empty(0))], names=[key, "score"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(score, f"`{key}` long, score double")


def above_quantile(scores: DataFrame, share: float, score: str = "score") -> DataFrame:
    """The rows whose score is over the quantile `share` of all scores (of Spark's approximate quantiles, error 0.001)."""
    cut = scores.approxQuantile(score, [share], 0.001)
    return scores.where(F.col(score) > cut[0]) if cut else scores
