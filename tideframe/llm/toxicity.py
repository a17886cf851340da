"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

Grades 0 to GRADES - 1 are ordered; P(grade <= k) is logistic in threshold k less one score that all thresholds share. The
score is linear in log(1 + count) of the words, and beginnings of words, that the labels tie to toxic documents. A document's severity is the
expected grade.

Where labels are binary, grades are made from them: 0 for label 0; for label 1, one to GRADES - 1 by the tertiles of how
many of those words it holds.

Learning reads at most TRAIN_ROWS labelled documents, the first in the order of a hash of their id, or all if they are
fewer. Everything else covers every document and whole texts.

Defined results: null and empty texts have severity by the thresholds alone; labels that are null, contradict themselves
or name no document don't count; without two classes of labels, severity is 0 and nothing is toxic; equal texts get equal
results; an empty table gives no rows. Only the named columns are used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
PREFIXES = (3, 4, 5, 6, 7)
LEAST_TOXIC = 3  # toxic documents that must hold a word of the model
SURE = 30.0  # least G-squared of a word of the model
GRADES = 4
L2 = 2e-4

WORD = regex.compile(r"[\p{L}\p{N}]+")


def tokens(text: str | None) -> Counter:
    """How often a text holds each word and, marked "^", each word's beginning of PREFIXES letters."""
    found = Counter(WORD.findall((text or "").lower()))
    for w, n in list(found.items()):
        for k in PREFIXES:
            if k < len(w):
                found["^" + w[:k]] += n
    return found


class Sparse:
    """Rows of few values: value k stands in row[k], column[k]. It multiplies as a matrix does; a row's sum goes by its columns."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    @property
    def T(self) -> Sparse:
        return Sparse(self.column, self.row, self.value, self.shape[::-1])


def stacked(rows: list[tuple[np.ndarray, np.ndarray]], columns: int) -> Sparse:
    """Rows given as columns and values."""
    row = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    return Sparse(row, np.concatenate([c for c, _ in rows] or [np.empty(0, np.int64)]), np.concatenate([v for _, v in rows] or [np.empty(0)]), (len(rows), columns))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class CumulativeLink:
    """Proportional odds: P(grade <= k) = sigmoid(thresholds[k] - x @ weights)."""

    def __init__(self, n_features: int, n_grades: int):
        self.weights, self.thresholds = np.zeros(n_features), np.arange(n_grades - 1, dtype=float)
        self.cut = 0.5  # chance of a grade over 0 from which on a document counts as toxic

    def fit(self, x: np.ndarray | Sparse, grade: np.ndarray, steps: int = 600, rate: float = 0.1, l2: float = L2) -> CumulativeLink:
        """Adam on the likelihood; thresholds stay ordered as the first and the logs of the gaps are learned."""
        k = len(self.thresholds)
        share = np.cumsum(np.bincount(grade, minlength=k + 1))[:k] / len(grade)
        first = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
        p = np.concatenate([self.weights, first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
        m, v, rows = np.zeros_like(p), np.zeros_like(p), np.arange(len(grade))
        for t in range(1, steps + 1):
            w, gaps = p[: x.shape[1]], np.exp(p[x.shape[1] + 1 :])
            theta = p[x.shape[1]] + np.concatenate([[0], np.cumsum(gaps)])
            below = np.pad(sigmoid(theta[None, :] - (x @ w)[:, None]), ((0, 0), (1, 1)), constant_values=((0, 0), (0, 1)))
            slope = below * (1 - below)
            mass = np.maximum(below[rows, grade + 1] - below[rows, grade], 1e-12)
            up, down = slope[rows, grade + 1] / mass, slope[rows, grade] / mass
            d_theta = np.zeros((len(grade), k + 2))
            d_theta[rows, grade + 1] += up
            d_theta[rows, grade] -= down
            g_theta = d_theta[:, 1 : k + 1].sum(0)
            tail = np.cumsum(g_theta[::-1])[::-1]
            grad = -np.concatenate([-(x.T @ (up - down)), tail[:1], tail[1:] * gaps]) / len(grade)
            grad[: x.shape[1]] += l2 * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = p[: x.shape[1]]
        self.thresholds = p[x.shape[1]] + np.concatenate([[0], np.cumsum(np.exp(p[x.shape[1] + 1 :]))])
        return self

    def at_least(self, x: np.ndarray | Sparse) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 - sigmoid(self.thresholds[None, :] - (x @ self.weights)[:, None])

    def choose_cut(self, x: np.ndarray | Sparse, grade: np.ndarray) -> CumulativeLink:
        """The cut of best F1 on the rows, midway to the next score below, so that rare toxic rows count as well."""
        p, y = self.at_least(x)[:, 0], grade > 0
        order = np.argsort(-p, kind="stable")
        hits, last = np.cumsum(y[order]), np.append(np.diff(p[order]) != 0, True)
        f1 = np.where(last, 2 * hits / (np.arange(1, len(p) + 1) + y.sum()), -1)
        best = int(np.argmax(f1))
        self.cut = float((p[order][best] + (p[order][best + 1] if best + 1 < len(p) else 0.0)) / 2)
        return self

    def severity(self, x: np.ndarray | Sparse) -> np.ndarray:
        return self.at_least(x).sum(axis=1)


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int) -> DataFrame:
    """key, text and label (int) of at most rows labelled documents."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    first = one.orderBy(F.xxhash64("_k"), "_k").limit(rows).select("_k", F.col("y").cast("int").alias("y"))
    return docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(first), "_k")  # at most `rows` pairs of numbers


def g_squared(k1: np.ndarray, n1: float, k0: np.ndarray, n0: float) -> np.ndarray:
    """Likelihood ratio of equal shares k1 / n1 and k0 / n0."""
    def part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)), 0.0)

    p = (k1 + k0) / (n1 + n0)
    return 2 * (part(k1, n1, p) + part(n1 - k1, n1, 1 - p) + part(k0, n0, p) + part(n0 - k0, n0, 1 - p))


def counts(text: str | None, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The model's words and beginnings that a text holds, by their columns, and log(1 + count) of each."""
    found = tokens(text)
    held = sorted((index[w], found[w]) for w in index.keys() & found.keys())
    return np.array([c for c, _ in held], np.int64), np.log1p(np.array([n for _, n in held], float))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> tuple[dict[str, int], CumulativeLink]:
    """The model's words and the fitted regression; labels are binary, or grades."""
    held = sample(docs, labels, label, key, text, rows)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, good, n = Counter(), Counter(), [0, 0]
            for t, y in zip(b.column(0), b.column(1), strict=True):
                (bad if y.as_py() > 0 else good).update(tokens(t.as_py()).keys())
                n[y.as_py() > 0] += 1
            found = sorted(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.string()), pa.array([n[1], *(bad[w] for w in found)], pa.int64()), pa.array([n[0], *(good[w] for w in found)], pa.int64())], names=["word", "bad", "good"])

    by_word = held.select("text", "y").mapInArrow(distinct, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = by_word.where(f"word is null or bad >= {LEAST_TOXIC}").toPandas()  # words of a bounded sample
    total = found[found["word"].isna()]
    n1, n0 = (float(total["bad"].sum()), float(total["good"].sum()))
    found = found[found["word"].notna()]
    if not n1 or not n0 or found.empty:
        return {}, CumulativeLink(0, GRADES)
    k1, k0 = found["bad"].to_numpy(float), found["good"].to_numpy(float)
    found = found.assign(g=np.where(k1 / n1 > k0 / n0, g_squared(k1, n1, k0, n0), 0.0))
    chosen = found[found["g"] >= SURE].sort_values(["g", "word"], ascending=[False, True])["word"].tolist()
    index = {w: i for i, w in enumerate(chosen)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [counts(t.as_py(), index) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([c.astype("<i4").tobytes() for c, _ in x], pa.binary()), pa.array([v.astype("<f8").tobytes() for _, v in x], pa.binary())], names=["k", "y", "c", "v"])

    got = held.select(F.col("_k").cast("string").alias("k"), "text", "y").mapInArrow(vectors, "k string, y int, c binary, v binary").toPandas().sort_values(["k", "c", "v"])
    x = stacked([(np.frombuffer(c, "<i4").astype(np.int64), np.frombuffer(v, "<f8")) for c, v in zip(got["c"], got["v"], strict=True)], len(index))
    y = got["y"].to_numpy()
    if y.max() == 1:
        hits = np.bincount(x.row, np.expm1(x.value), len(y))
        edges = np.quantile(hits[y == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
        y = np.where(y == 1, 1 + np.searchsorted(edges, hits, side="right"), 0)
    return index, CumulativeLink(len(index), int(max(GRADES, y.max() + 1))).fit(x, y.astype(int)).choose_cut(x, y.astype(int))


def toxicity(docs: DataFrame, index: dict[str, int], model: CumulativeLink, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (long), severity (expected grade), p_toxic, grade (the median one; at least 1 where toxic, else 0) and toxic of each document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            over = np.zeros((b.num_rows, len(model.thresholds)))
            if index:
                over = model.at_least(stacked([counts(t.as_py(), index) for t in b.column(1)], len(index)))
            p, toxic = np.round(over, 9), over[:, 0] >= model.cut
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(np.where(toxic, np.maximum(1, (p >= 0.5).sum(axis=1)), 0).astype(np.int32)), pa.array(toxic)], names=[key, "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(score, f"`{key}` long, severity double, p_toxic double, grade int, toxic boolean")
