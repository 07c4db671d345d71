"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by what stands in it alone: its words and their endings in
hashed counts, and shares of classes of characters, through a learned layer. Gated attention weighs the passages
against each other, and the weighted representation is scored. Only documents have labels; the attention learns
which passages decide, and nothing that is counted over a whole document goes round it.

Training is full-batch gradient descent on a bounded labelled sample in the driver. Scoring is a projection over
whole texts: a passage costs a few vectorised sums over its bytes and words.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .learning import best_cut, class_weights, in_training, labelled_sample, sigmoid

#: Classes of bytes that are counted in a passage.
GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>=@^~\\{}[]_+", b"|", b"!?", b".,;:", b"\n", bytes(range(128, 256)))
_TABLE = np.zeros(256, np.int64)
for _i, _g in enumerate(GROUPS, 1):
    _TABLE[list(_g)] = _i
_DIGITS = bytes(48 if 48 <= i < 58 else i for i in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Buckets that words are counted in, and as many for their endings.
BUCKETS = 64
N_FEATURES = len(GROUPS) + 3 + 2 * BUCKETS


@lru_cache(maxsize=200_000)
def _buckets(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its last three bytes; digits are alike."""
    word = word.translate(_DIGITS)
    return crc32(word) % BUCKETS, BUCKETS + crc32(b"$" + word[-3:]) % BUCKETS


def passages(text: str, words: int = 64) -> np.ndarray:
    """A row of features for every run of ``words`` words; a text without words has one row of zeros."""
    data = text.encode()
    tokens = data.lower().split()
    if not tokens:
        return np.zeros((1, N_FEATURES), np.float32)
    b = np.frombuffer(data, np.uint8)
    blank = _BLANK[b]
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])[::words]
    first[0] = 0
    place = np.zeros(len(b), np.int64)
    place[first[1:]] = 1
    k, n = len(first), len(GROUPS) + 1
    counts = np.bincount(np.cumsum(place) * n + _TABLE[b], minlength=k * n).reshape(k, n)[:, 1:]
    size = np.diff(np.r_[first, len(b)])
    parts = [tokens[i : i + words] for i in range(0, len(tokens), words)]
    own = np.array([len(p) for p in parts])
    distinct = np.array([len(set(p)) for p in parts]) / own
    length = np.array([sum(map(len, p)) for p in parts]) / own
    at = np.array([_buckets(t) for t in tokens], np.int64) + (np.arange(len(tokens)) // words * (2 * BUCKETS))[:, None]
    lexical = np.bincount(at.ravel(), minlength=k * 2 * BUCKETS).reshape(k, 2 * BUCKETS)
    return np.c_[counts / size[:, None], distinct, np.log1p(length), np.log1p(own), np.sqrt(lexical / own[:, None])].astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """Encoder, gated attention and scorer; ``constant`` stands in where the sample has one label only."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    encode: np.ndarray | None = None
    value: np.ndarray | None = None
    gate: np.ndarray | None = None
    attend: np.ndarray | None = None
    score: np.ndarray | None = None
    words: int = 64
    shift: float = 0.0
    constant: float | None = None


def _softmax(scores: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, scores)
    e = np.exp(scores - top[bag])
    return e / np.bincount(bag, e, n)[bag]


def _forward(x: np.ndarray, bag: np.ndarray, n: int, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["encode"])
    v, g = np.tanh(h @ p["value"]), sigmoid(h @ p["gate"])
    a = _softmax((v * g) @ p["attend"], bag, n)
    z = np.stack([np.bincount(bag, a * h[:, j], n) for j in range(h.shape[1])], 1)
    return {"h": h, "v": v, "g": g, "a": a, "z": z, "out": np.c_[z, np.ones(n)] @ p["score"]}


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, *, width: int = 12, steps: int = 150, rate: float = 0.03, decay: float = 1e-3, seed: int = 7) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Parameters by Adam, the features' means and scales, and the bags' scores."""
    bag, n = np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags)
    x = np.ones((len(bag), bags[0].shape[1] + 1), np.float32)  # the last column is the constant
    np.concatenate(bags, out=x[:, :-1], casting="same_kind")
    del bags
    mean, scale = x[:, :-1].mean(0, dtype=np.float64).astype(np.float32), x[:, :-1].std(0, dtype=np.float64).astype(np.float32) + np.float32(1e-6)
    for rows in np.array_split(x[:, :-1], max(1, len(x) // 4096)):
        rows[:] = np.clip((rows - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    shapes = {"encode": (x.shape[1], width), "value": (width, width), "gate": (width, width), "attend": (width,), "score": (width + 1,)}
    p = {k: rng.normal(0, 0.3 if k != "encode" else 1.2 / x.shape[1] ** 0.5, s).astype(np.float32) for k, s in shapes.items()}
    m, s = ({k: np.zeros(v) for k, v in shapes.items()} for _ in range(2))
    for t in range(1, steps + 1):
        f = _forward(x, bag, n, p)
        err = weight * (sigmoid(f["out"]) - y) / n
        dz = err[:, None] * p["score"][:-1]
        da = (dz[bag] * f["h"]).sum(1)
        ds = f["a"] * (da - np.bincount(bag, f["a"] * da, n)[bag])
        dvg = ds[:, None] * p["attend"]
        dv, dg = dvg * f["g"] * (1 - f["v"] ** 2), dvg * f["v"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[bag] + dv @ p["value"].T + dg @ p["gate"].T) * (1 - f["h"] ** 2)
        grads = {"encode": x.T @ dh, "value": f["h"].T @ dv, "gate": f["h"].T @ dg, "attend": (f["v"] * f["g"]).T @ ds, "score": np.r_[f["z"].T @ err, err.sum()]}
        for k, grad in grads.items():
            grad = grad + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad**2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p, mean, scale, _forward(x, bag, n, p)["out"]


def fit(sample: Iterable[tuple[str, int]], counts: dict[int, int], *, words: int = 64, at: float = 0.3, **options) -> QualityModel:
    """Trains on ``(text, label)``; the scores are shifted so that ``at`` is the best cut between the labels.

    The best cut is that of F1 for label 0, the rarer one.
    """
    rows = list(sample)
    y = np.array([y for _, y in rows], float)
    if not 0 < y.sum() < len(y):
        return QualityModel(constant=float(y[0]) if len(y) else 0.0)
    weight = class_weights(y, counts)
    p, mean, scale, out = train([passages(t, words) for t, _ in rows], y, weight, **options)
    shift = float(np.log(at / (1 - at))) + best_cut(-out, 1 - y, weight)
    return QualityModel(mean, scale, **p, words=words, shift=shift)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, positives: int = 2000, negatives: int = 2000, **options) -> QualityModel:
    """Trains on at most ``positives`` and ``negatives`` labelled rows, read whole."""
    return fit(*labelled_sample(docs, labels, id_col, text_col, label_col, positives, negatives), **options)


def score_text(text: str | None, model: QualityModel) -> float:
    if model.constant is not None:
        return model.constant
    x = passages(text or "", model.words)
    x = np.c_[np.clip((x - model.mean) / model.scale, -8, 8), np.ones(len(x))]
    h = np.tanh(x @ model.encode)
    raw = (np.tanh(h @ model.value) * sigmoid(h @ model.gate)) @ model.attend
    a = np.exp(raw - raw.max())
    return float(sigmoid(np.append((a / a.sum()) @ h, 1.0) @ model.score + model.shift))


def quality(text: Column, model: QualityModel) -> Column:
    """From 0 to 1, higher for text like that labelled 1. Null and empty texts count as one empty passage."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, model) for t in texts], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels").where(in_training("doc_id")))
    scored = docs.select("doc_id", (~in_training("doc_id")).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
