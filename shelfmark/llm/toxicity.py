"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the toxic passages of toxic text.
The toxic dictionary goes behind the ordinary one, so both compressors know ordinary text alike: a window that
gets shorter when the toxic dictionary is there holds toxic material, and ordinary windows differ by nearly nothing.
How much evidence a saving of so many bytes is, is calibrated on labelled texts that no dictionary was trained
on: the log ratio of its shares among windows of toxic and ordinary text. A document's evidence is the sum over
its windows, less what their number alone would bring, as a mean over a few window sizes; a logistic curve makes it
a score with the threshold at 0.5.

Passages: most words of a toxic text are ordinary, and a dictionary trained on all of them spends itself on
those. So the trainer is given the spans whose words or beginnings of words stand in significantly more contexts in
toxic than in ordinary text.

Only a sample bounded by parameters comes to the driver. Scoring is a projection over whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .learning import best_cut, class_weights, in_training, labelled_sample, logistic, sigmoid

EDGES = b".,;:!?\"'()[]"
#: Bytes saved in a window, from none to the most that is told apart.
MOST = 12


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries and calibration; a model of a sample with one label only scores every text ``constant``."""

    ordinary: bytes = b""
    toxic: bytes = b""
    windows: tuple[int, ...] = (8, 12, 16)
    evidence: tuple[tuple[float, ...], ...] = ()
    for_each: tuple[float, ...] = ()
    slope: float = 1.0
    cut: float = 0.0
    constant: float | None = None


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _marks(word: bytes) -> list[bytes]:
    """A word as a whole, and its beginnings of four to six bytes."""
    return [b" %b " % word, *(b" " + word[:k] for k in range(4, min(7, len(word))))]


def _windows(words: list[bytes], size: int) -> list[bytes]:
    return [b" %b " % b" ".join(words[i : i + size]) for i in range(0, len(words), size)] or [b""]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(1, min_match=4, strategy=zstandard.STRATEGY_LAZY, window_log=17, hash_log=15, chain_log=15, search_log=4, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


@lru_cache(maxsize=4)
def _pair(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(ordinary), _compressor(ordinary + toxic)


def _savings(words: list[bytes], ordinary: bytes, toxic: bytes, window: int) -> np.ndarray:
    """Bytes by which the toxic dictionary shortens each window, from 0 to ``MOST``."""
    alone, both = (c.compress for c in _pair(ordinary, toxic))
    return np.clip([len(alone(w)) - len(both(w)) for w in _windows(words, window)], 0, MOST)


def _evidence(words: list[bytes], model: ToxicityModel) -> float:
    """The mean over the window sizes."""
    total = 0.0
    for window, evidence, for_each in zip(model.windows, model.evidence, model.for_each):
        saved = _savings(words, model.ordinary, model.toxic, window)
        total += np.array(evidence)[saved].sum() - for_each * len(saved)
    return total / len(model.windows)


def _train(size: int, samples: list[bytes], segment: int, unit: int) -> bytes:
    """A dictionary of the samples; as they are where zstandard finds them too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=unit).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _contexts(texts: Iterable[bytes]) -> tuple[int, dict[bytes, int]]:
    """In how many contexts each word stands, and the sum of that."""
    ids: dict[bytes, int] = {b"": 0}
    pairs = []
    for text in texts:
        own = np.array([ids.setdefault(w.strip(EDGES), len(ids)) for w in text.split()], np.uint64)
        pairs.append(np.r_[np.uint64(0), own[:-1]][: len(own)] << np.uint64(32) | own)
    found = np.unique(np.concatenate(pairs))
    counts = np.bincount((found & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(ids))
    return max(1, len(found)), dict(zip(ids, counts.tolist()))


def _marks_of(toxic: list[bytes], ordinary: list[bytes], deviations: float, purity: float, least: int) -> set[bytes]:
    """Words and beginnings of words in significantly more contexts of toxic than of ordinary text.

    A word's contexts are the words before it, so that copies of a text count once. Beginnings count beside whole
    words, for stems that take many endings; one stays if no longer mark, and no single word, accounts for most of it.
    """
    (toxic_size, toxic_words), (ordinary_size, ordinary_words) = _contexts(toxic), _contexts(ordinary)
    seen = Counter()
    for word, n in toxic_words.items():
        for mark in _marks(word):
            seen[mark] += n
    seen = {mark: n for mark, n in seen.items() if n >= least and mark.strip()}
    plain = dict.fromkeys(seen, 0)
    for word, n in ordinary_words.items():
        for mark in _marks(word):
            if mark in plain:
                plain[mark] += n
    excess = lambda m: (seen[m] - deviations * math.sqrt(seen[m])) / toxic_size - purity * (plain[m] + 2 * math.sqrt(plain[m] + 1)) / ordinary_size
    most = Counter()
    for mark, n in seen.items():
        for shorter in _marks(mark.strip())[1:] if mark.endswith(b" ") else [mark[:-1]]:
            if shorter != mark:
                most[shorter] = max(most[shorter], n)
    return {m for m in seen if excess(m) > 0 and (m.endswith(b" ") or most[m] <= 0.6 * seen[m])}


def fit(sample: Iterable[tuple[str, int]], counts: dict[int, int], *, windows: tuple[int, ...] = (8, 12, 16), ordinary_size: int = 16384, toxic_size: int = 3000, segment: int = 24, unit: int = 8, deviations: float = 3.0, purity: float = 5.0, least: int = 10) -> ToxicityModel:
    """Trains on ``(text, label)``; ``counts``: how many rows have each label in all.

    Every fifth text of a label calibrates, the others train the dictionaries; copies of a text are one. ``segment`` and
    ``unit`` are the trainer's. Windows, sizes and those two were chosen by cross-validation among training rows.
    """
    texts = [(t, y) for t, y in dict.fromkeys((t.encode().lower(), y) for t, y in sample)]
    labels = {y for _, y in texts}
    if labels != {0, 1}:
        return ToxicityModel(constant=float(labels.pop()) if labels else 0.0)
    train, calibrate = ([x for own in (0, 1) for i, x in enumerate(t for t in texts if t[1] == own) if (i % 5 == 4) == late] for late in (False, True))
    if {y for _, y in calibrate} != {0, 1}:
        train = calibrate = texts
    ordinary_texts, toxic_texts = ([t for t, y in train if y == own] for own in (0, 1))
    marks = _marks_of(toxic_texts, ordinary_texts, deviations, purity, least)
    passages = [b" %b " % w for t in toxic_texts for w in (x.strip(EDGES) for x in t.split()) if not marks.isdisjoint(_marks(w))]
    ordinary = _train(ordinary_size, [w for t in ordinary_texts for w in _windows(t.split(), 8) if w] or [b" "], 64, 6)
    toxic = _train(toxic_size, passages or [b" "], segment, unit)
    y = np.array([y for _, y in calibrate], float)
    weight = class_weights(y, counts)
    evidence, for_each = [], []
    for window in windows:
        shares = np.ones((2, MOST + 1))
        for t, label in calibrate:
            shares[label] += np.bincount(_savings(t.split(), ordinary, toxic, window), minlength=MOST + 1)
        shares /= shares.sum(1, keepdims=True)
        # Larger savings are never less evidence; one of up to a byte, what ordinary windows have by chance, is none.
        evidence.append(tuple(np.maximum.accumulate(np.maximum(np.log(shares[1] / shares[0]), 0) * (np.arange(MOST + 1) > 1))))
        for_each.append(float((shares[1] - shares[0])[2:].sum()))
    model = ToxicityModel(ordinary, toxic, windows, tuple(evidence), tuple(for_each))
    raw = np.array([_evidence(t.split(), model) for t, _ in calibrate])
    slope = max(float(logistic(np.c_[raw / 10, np.ones(len(raw))], y, weight)[0]) / 10, 1e-3)
    return replace(model, slope=slope, cut=best_cut(raw, y, weight))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, positives: int = 1200, negatives: int = 3600, **options) -> ToxicityModel:
    """Trains on at most ``positives`` and ``negatives`` labelled rows, read whole."""
    return fit(*labelled_sample(docs, labels, id_col, text_col, label_col, positives, negatives), **options)


def score_text(text: str | None, model: ToxicityModel) -> float:
    if model.constant is not None:
        return model.constant
    return float(sigmoid(model.slope * (_evidence(_words(text or ""), model) - model.cut)))


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """From 0 to 1, at 0.5 the calibrated threshold. Null and empty texts are scored as texts without words."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, model) for t in texts], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they were."""
    return docs.where(toxicity(F.col(text_col), model) < threshold)


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels").where(in_training("doc_id")))
    scored = docs.select("doc_id", (~in_training("doc_id")).alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
