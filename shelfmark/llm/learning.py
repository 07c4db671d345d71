"""What the trained classifiers share: the bounded sample of labelled rows, logistic regression, thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_training(id_col: str) -> F.Column:
    """Whether a row may be learned from: those whose crc32 of the id as text isn't divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, positives: int, negatives: int, longest: int = 50_000) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most so many texts of label 1 and 0, those of the smallest hashes of their ids, in that order; and how
    many rows have each label. Rows without id or label are left out, a null text is empty. Texts of more than
    ``longest`` characters teach nothing (they are scored whole all the same), so the sample's size is bounded.

    The ids are so few that they are broadcast; the sample is all that comes to the driver.
    """
    known = labels.select(id_col, F.col(label_col).cast("int").alias("label")).dropna().where("label in (0, 1)").dropDuplicates([id_col])
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64(F.col(id_col).cast("string")), F.col(id_col))
    chosen = known.where("label = 1").orderBy(*order).limit(positives).unionByName(known.where("label = 0").orderBy(*order).limit(negatives))
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= longest).join(F.broadcast(chosen), id_col).dropDuplicates([id_col]).orderBy(*order).select("text", "label").collect()
    return [(r["text"], r["label"]) for r in rows], counts


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the classes of a sample the shares that they have among all labels; their mean is 1."""
    share = {c: counts.get(c, 0) / max(1, sum(counts.values())) for c in (0, 1)}
    return np.where(y == 1, share[1] / max(1e-9, (y == 1).mean()), share[0] / max(1e-9, (y == 0).mean()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Coefficients by Newton's method; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score from which on calling a row 1 gives the best F1."""
    order = np.argsort(-score, kind="stable")
    s, hit, all_ = score[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])
