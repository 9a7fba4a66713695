"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon learnt from the training rows, its strongest hits, second-person words
near lexicon words, capitals, punctuation, and obfuscation (digits or symbols inside words). Null counts as empty.
At most TRAIN_ROWS labelled rows are taken, chosen by a hash of their id. Without labels of both kinds scores are the base rate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS, LEXICON, ROUNDS, DEPTH, RATE = 6000, 64, 60, 3, 0.15
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][0-9@$*!][^\W\d_]")
#: Second-person words.
SECOND = {"you", "your", "yours", "u", "du", "dich", "dein", "deine", "tu", "te", "ton", "toi", "vous", "usted", "tú"}


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    raw = _WORD.findall(text)
    words = [w.lower() for w in raw]
    n, chars = max(1, len(words)), max(1, len(text))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    weight = sum(lexicon[words[i]] for i in hits)
    you = [i for i, w in enumerate(words) if w in SECOND]
    close = 0
    if hits and you:
        h, y = np.array(hits), np.array(you)
        at = np.searchsorted(h, y)
        gap = np.minimum(np.abs(h[np.minimum(at, len(h) - 1)] - y), np.abs(h[np.maximum(at - 1, 0)] - y))
        close = int((gap <= 5).sum())
    return [
        len(hits) / n, weight / n, math.log1p(len(hits)), len({words[i] for i in hits}), weight, len(you) / n, close / n,
        sum(w.isupper() and len(w) > 1 for w in raw) / n, sum(text.count(c) for c in "!?") / chars, len(_MIXED.findall(text)) / n, math.log1p(n),
    ]


@dataclass
class ToxicityModel:
    base: float
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: list[list[tuple[int, float]]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), math.log(max(1e-6, self.base) / max(1e-6, 1 - self.base)))
        for splits, leaves in zip(self.trees, self.leaves, strict=True):
            z += RATE * leaves[leaf_of(x, splits)]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def leaf_of(x: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """Splits are stored as a heap; a missing split has feature -1 and sends all rows left."""
    at = np.zeros(len(x), np.int64)
    f, t = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    for _ in range(DEPTH):
        right = (f[at] >= 0) & (x[np.arange(len(x)), np.maximum(f[at], 0)] > t[at])
        at = 2 * at + 1 + right
    return at - (2**DEPTH - 1)


def boost(x: np.ndarray, y: np.ndarray, model: ToxicityModel) -> None:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 32))) for j in range(x.shape[1])]
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-model.raw(x)))
        g, h = y - p, p * (1 - p) + 1e-9
        splits, at = [(-1, 0.0)] * (2**DEPTH - 1), np.zeros(len(x), np.int64)
        for node in range(2**DEPTH - 1):
            rows = at == node
            best = (1e-6, -1, 0.0)
            if rows.sum() >= 20:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, cut in enumerate(cuts):
                    bins = np.searchsorted(cut, x[rows, j], "left")
                    gl = np.cumsum(np.bincount(bins, g[rows], len(cut) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins, h[rows], len(cut) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, cut[k])
            splits[node] = (best[1], best[2])
            right = rows & (best[1] >= 0) & (x[:, max(best[1], 0)] > best[2])
            at = np.where(rows, 2 * node + 1 + right, at)
        leaf = at - (2**DEPTH - 1)
        model.trees.append(splits)
        model.leaves.append(np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1))


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (raw scores, calibrated probabilities), each block smoothed by one half row of each kind."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(z, y, strict=True)):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in [(b[0] + 0.05) / (b[1] + 0.1)] * 2])
    return xs, np.maximum.accumulate(ys)


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> ToxicityModel:
    model = ToxicityModel(float(y.mean()) if len(y) else 0.0)
    if len(y) < 20 or y.min() == y.max():
        return model
    bad, good = Counter(), Counter()
    for t, v in zip(texts, y, strict=True):
        (bad if v else good).update({w.lower() for w in _WORD.findall(t)})
    nb, ng = y.sum(), len(y) - y.sum()
    odds = {w: math.log((c + 0.5) / (nb + 1)) - math.log((good[w] + 0.5) / (ng + 1)) for w, c in bad.items() if c >= max(3, nb / 100)}
    model.lexicon = {w: odds[w] for w in sorted(odds, key=lambda w: (-odds[w] * math.sqrt(bad[w]), w))[:LEXICON] if odds[w] > 0.7}
    x = np.array([features(t, model.lexicon) for t in texts])
    order = np.random.default_rng(seed).permutation(len(y))
    fit, held = order[: len(y) * 3 // 4], order[len(y) * 3 // 4 :]
    boost(x[fit], y[fit], model)
    model.steps = isotonic(model.raw(x[held]), y[held])
    return model


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows = labels.where("toxic is not null").select(F.col("doc_id").alias("k"), F.col("toxic").alias("y")).where(F.crc32(F.col("k").cast("string")) % 3 != 1)
    picked = rows.orderBy(F.xxhash64(F.col("k").cast("string")), "k", "y").limit(TRAIN_ROWS)
    got = docs.select(F.col("doc_id").alias("k"), "text").join(F.broadcast(picked), "k").select("k", "y", "text").limit(2 * TRAIN_ROWS).toPandas().sort_values(["k", "y"], kind="stable")
    return train([t or "" for t in got["text"]], got["y"].to_numpy(np.float64))


def scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            m = shared.value
            x = np.array([features(t, m.lexicon) for t in b.column(1).to_pylist()]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x) if b.num_rows else [], pa.float64())], [id_col, "score"])

    return docs.select(id_col, "text").mapInArrow(run, docs.select(id_col).schema.add("score", "double"))
