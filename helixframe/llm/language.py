"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

Null texts and texts without a letter get ``und`` and score 0. With no labelled row every text does. Rows repeat as given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import fresh

#: Hash buckets of byte 2- and 3-grams, embedding width, and the bound on labelled rows that training takes.
BUCKETS, DIM, TRAIN_ROWS = 4096, 16, 1500
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Relative frequencies of the hashed byte 2- and 3-grams of the whole text, in pieces of 1 MB that overlap by two bytes."""
    data = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode(), np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for i in range(0, max(1, len(data) - 2), 1 << 20):
        a = data[i : i + (1 << 20) + 2].astype(np.uint32)
        two, three = a[:-2] * 257 + a[1:-1], (a[:-2] * 257 + a[1:-1]) * 257 + a[2:]
        out += np.bincount((two * np.uint32(2654435761) >> np.uint32(20)) % BUCKETS, minlength=BUCKETS)
        out += np.bincount((three * np.uint32(2246822519) >> np.uint32(20)) % BUCKETS, minlength=BUCKETS)
    return (out / max(1, out.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    embed: np.ndarray
    linear: np.ndarray
    heat: float
    reject: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not _LETTER.search(text):
            return "und", 0.0
        z = (np.sqrt(grams(text)) @ self.embed @ self.linear).astype(np.float64) / self.heat
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def train(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 7) -> LanguageModel:
    """SGD on four fifths; the temperature and the rejection threshold come from the rest."""
    rng = np.random.default_rng(seed)
    x = np.sqrt(x)
    embed = rng.normal(0, 0.3, (x.shape[1], DIM)).astype(np.float32)
    linear = rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32)
    order = rng.permutation(len(x))
    cut = max(1, len(x) * 4 // 5)
    fit, held = order[:cut], order[cut:] if cut < len(x) else order
    for epoch in range(12):
        rng.shuffle(fit)
        for i in range(0, len(fit), 16):
            rows = fit[i : i + 16]
            hidden = x[rows] @ embed
            z = hidden @ linear
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            rate = 0.5 / (1 + epoch / 4) / len(rows) * 4
            step = hidden.T @ p
            embed -= rate * (x[rows].T @ (p @ linear.T))
            linear -= rate * step

    def probabilities(heat: float) -> np.ndarray:
        z = (x[held] @ embed @ linear).astype(np.float64) / heat
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    heat = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(probabilities(t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    p = probabilities(heat)
    right = p.argmax(1) == y[held]
    reject = min(0.5, float(np.quantile(p.max(1)[right], 0.001))) if right.any() else 0.0
    return LanguageModel(langs, embed, linear, heat, reject)


def fit(docs: DataFrame, id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learns from at most `rows` labelled documents, chosen by a hash of their id; their features are made on the executors."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    ids = labelled.select(F.col(id_col).alias("k"), F.xxhash64(F.col(id_col).cast("string")).alias("o")).orderBy("o", "k").limit(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "lang": b["lang"], "x": [grams(t).tobytes() for t in b["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    picked = labelled.select(F.col(id_col).alias("k"), "lang", "text").join(F.broadcast(ids.select("k").distinct()), "k", "left_semi")
    got = picked.mapInPandas(run, f"k {kind}, lang string, x binary").limit(2 * rows).toPandas().sort_values("k", kind="stable")
    langs = sorted(set(got["lang"]))
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1), np.float32), 1.0, 0.0)
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]])
    return train(x, np.array([langs.index(v) for v in got["lang"]]), langs)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of `keep`, then the predicted language and its score under `names`; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names[:-1], *names])

    return docs.select(*keep, F.col("text").alias(fresh(docs, "text"))).mapInArrow(run, schema)


def without_rejected(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents whose language the calibrated classifier accepts; columns stay as they are."""
    names = fresh(docs, "lang"), fresh(docs, "score")
    found = identify(docs, model, docs.columns, names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= model.reject)).select(*docs.columns)
