"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of word n-grams (one and two words) and of shape n-grams (one to three shapes; a
word's shape keeps its punctuation and maps letter and digit runs to a, A and 0). Each indicator is scaled
by the log ratio of its smoothed counts in the two classes; a linear hinge-loss model is then fitted on the
scaled rows by dual coordinate descent, mixed with its mean weight, and its margins are turned into
probabilities on rows that its fit did not see.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import LONGEST, WORDS, mixed, rolling
from .learn import Sparse, found, labelled_sample, sample_features, scored, sigmoid

THRESHOLD = 0.3
#: Cost of a margin's violation, share of the fitted weights in the mix, sweeps over the rows.
COST, MIX, SWEEPS = 1.0, 0.5, 12
_RUNS = [(re.compile(p), r) for p, r in ((rb"[A-Z]+", b"A"), (rb"[a-z\x80-\xff]+", b"a"), (rb"[0-9]+", b"0"), (rb"([^\w])\1+", rb"\1+"))]


class _Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        shape = word
        for pattern, to in _RUNS:
            shape = pattern.sub(to, shape)
        value = xxhash.xxh3_64_intdigest(b"\0shape " + shape)
        if len(word) <= LONGEST:
            self[word] = value
        return value


_SHAPES = _Shapes()


def features(text: bytes) -> np.ndarray:
    """Sorted distinct 32-bit ids of a text's n-gram indicators."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint32)
    w = WORDS.of([x.lower() for x in words])
    s = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, len(words))
    all_of = np.concatenate([mixed(w), rolling(w, 2), rolling(s, 1), rolling(s, 2), rolling(s, 3)])
    return np.unique((all_of >> np.uint64(32)).astype(np.uint32))


def _dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: np.ndarray) -> np.ndarray:
    """Weights of the L2-regularised hinge loss; the last weight is the bias."""
    w, alpha, rng = np.zeros(n + 1), np.zeros(len(rows)), np.random.default_rng(7)
    size = np.array([v @ v + 1 for v in values])
    for _ in range(SWEEPS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / size[i], 0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability of y = 1 given the margin, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(p - y) @ margin + 1e-3 * a, (p - y).sum()])
        h = np.array([[v @ margin**2 + 1e-3, v @ margin], [v @ margin, v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """The model: feature ids, their weights, bias, calibration. One class or no rows: its share, for every text."""
    share = float((labels.sum() + 1) / (len(labels) + 2))
    if len(labels) < 10 or labels.min() == labels.max():
        return {"ids": np.empty(0, np.uint32), "r": np.empty(0), "w": np.empty(0), "bias": 0.0, "ab": (0.0, float(np.log(share / (1 - share))))}
    x = Sparse(rows)
    ones = x.back((labels == 1).astype(float)) + 1
    zeros = x.back((labels == 0).astype(float)) + 1
    r = np.log((ones / ones.sum()) / (zeros / zeros.sum()))
    y = np.where(labels == 1, 1.0, -1.0)
    values = [r[p] / max(np.sqrt((r[p] ** 2).sum()), 1e-9) for p in x.rows]
    cost = COST * np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    # folds only for the calibration
    margin = np.empty(len(y))
    fold = np.arange(len(y)) % 3
    for f in range(3):
        own = np.flatnonzero(fold != f)
        w = _dual_descent([x.rows[i] for i in own], [values[i] for i in own], y[own], len(x.ids), cost[own])
        w = _mixed_weights(w)
        for i in np.flatnonzero(fold == f):
            margin[i] = w[x.rows[i]] @ values[i] + w[-1]
    ab = _calibrated(margin, labels.astype(float))
    w = _mixed_weights(_dual_descent(x.rows, values, y, len(x.ids), cost))
    return {"ids": x.ids, "r": r, "w": w[:-1], "bias": float(w[-1]), "ab": ab}


def _mixed_weights(w: np.ndarray) -> np.ndarray:
    """The fitted weights mixed with their mean size, which leaves the scaled counts a vote of their own."""
    out = w.copy()
    out[:-1] = MIX * w[:-1] + (1 - MIX) * np.abs(w[:-1]).mean()
    return out


def probability(model: dict, ids: np.ndarray) -> float:
    at = found(model["ids"], ids)
    r = model["r"][at]
    margin = (model["w"][at] @ r) / max(np.sqrt((r**2).sum()), 1e-9) + model["bias"] if len(at) else model["bias"]
    return float(sigmoid(model["ab"][0] * margin + model["ab"][1]))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score (probability that ``label`` is 1) and predicted.

    Fitted on at most TRAIN_ROWS labelled rows outside the held-out fold. A null text is scored as an empty
    one; an empty table stays empty; without usable labels every score is one half. Columns of ``docs`` by
    the names of the three results are replaced; equal texts have equal scores.
    """
    rows, y = sample_features(docs, labelled_sample(labels, label), features)
    return scored(docs, features, probability, fit(rows, y), threshold)
