"""Document quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling 2018).

A document is a bag of passages of PASSAGE words. Each passage is encoded as a vector: shares of kinds of
words (case, digits, symbols, marks, length), repetition, and signed hashes of its words. Gated attention
a_k = softmax(w . (tanh(V h_k) * sigmoid(U h_k))) is learnt from document labels alone; the score is
sigmoid(c . sum_k a_k h_k + b), so one bad passage can decide a long document.

The model is fitted in one task on a bounded sample (at most SAMPLE labelled rows, chosen by hashed key) and
is a few thousand numbers; every passage of every row is scored, without a shuffle.

Defined results: a null or empty text is one empty passage; labels other than 0 or 1 are not learnt from;
without labelled rows every score is PRIOR; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, fold, release_memory, texts, tidy
from .toxicity import labelled_sample

PASSAGE = 64
SAMPLE = 6_000
HASHED = 16
KINDS = 12
SIZE = KINDS + 5 + HASHED
ATTENTION = 16
EPOCHS, RATE, DECAY = 30, 0.01, 1e-4
PRIOR = 0.5
REMEMBERED = 400_000

_shared: dict = {}


def forget() -> None:
    """Drops what this Python worker has remembered."""
    _shared.clear()


def word_kind(word: str) -> list[float]:
    """Traits of one word: length, case, digits, symbols, marks, then signed hash places."""
    n = len(word)
    letters = sum(map(str.isalpha, word))
    digits = sum(map(str.isdigit, word))
    marks = n - letters - digits
    bare = word.strip(".,;:!?\"'()").lower()
    h = xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass"))
    signs = [0.0] * HASHED
    signs[h % HASHED] = 1.0 if h >> 40 & 1 else -1.0
    return [
        min(n, 30) / 10,
        float(word.isupper() and letters > 1),
        float(word.istitle()),
        float(word.islower()),
        digits / n,
        marks / n,
        float(word.endswith((".", ","))),
        float(word.endswith(("!!", "??"))),
        float(letters == 0),
        float(any(c in "#*$%&|<>{}=~^_" for c in word)),
        float(n > 20),
        float(n <= 3),
        *signs,
    ]


class _Words(dict):
    def __init__(self):
        self.table = np.zeros((REMEMBERED, KINDS + HASHED), np.float32)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.table[row] = word_kind(word)
        return row


def encode(text: str) -> np.ndarray:
    """One row of SIZE numbers for each passage of PASSAGE words, the last one shorter."""
    words = _shared.setdefault("words", _Words())
    split = text.split()
    if not split:
        out = np.zeros((1, SIZE), np.float32)
        out[0, KINDS + 2] = 1.0
        return out
    found = []
    step = PASSAGE * (REMEMBERED // 4 // PASSAGE)
    for a in range(0, len(split), step):
        part = split[a : a + step]
        if len(words) + len(part) > REMEMBERED:
            words.clear()
        rows = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
        starts = np.arange(0, len(rows), PASSAGE)
        sizes = np.diff([*starts, len(rows)]).astype(np.float32)
        means = np.add.reduceat(words.table[rows], starts, axis=0) / sizes[:, None]
        again = np.concatenate(([False], rows[1:] == rows[:-1])).astype(np.float32)
        ordered = np.sort(np.arange(len(rows)) // PASSAGE * np.int64(REMEMBERED) + rows)
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        distinct = np.bincount(ordered[new] // REMEMBERED, minlength=len(starts)) / sizes
        extra = np.stack((np.add.reduceat(again, starts) / sizes, distinct, np.zeros(len(starts)), np.minimum(len(split), 50) / 50 * np.ones(len(starts)), sizes / PASSAGE), axis=1)
        found.append(np.concatenate((means[:, :KINDS], extra, means[:, KINDS:] * np.sqrt(sizes)[:, None]), axis=1))
    return np.concatenate(found).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def forward(p: dict[str, np.ndarray], h: np.ndarray, bag: np.ndarray, starts: np.ndarray):
    """Scores of bags, with what the gradient needs. Softmax within each bag."""
    t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return sigmoid(z @ p["c"] + p["b"][0]), t, s, a, z


def gradients(p: dict[str, np.ndarray], h: np.ndarray, bag: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    score, t, s, a, z = forward(p, h, bag, starts)
    d = (score - y) * weight / weight.sum()
    da = (h @ p["c"]) * d[bag]
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dts = de[:, None] * p["w"]
    return {"c": z.T @ d, "b": np.array([d.sum()]), "w": (t * s).T @ de, "V": h.T @ (dts * s * (1 - t * t)), "U": h.T @ (dts * t * s * (1 - s))}


def learn(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam over mini-batches of bags; the rarer label weighs more, and inputs are standardised."""
    everything = np.concatenate(bags)
    mean, sd = everything.mean(0), everything.std(0) + 1e-3
    bags = [(b - mean) / sd for b in bags]
    rng = np.random.default_rng(7)
    shapes = {"V": (SIZE, ATTENTION), "U": (SIZE, ATTENTION), "w": (ATTENTION,), "c": (SIZE,), "b": (1,)}
    p = {k: rng.normal(0, 0.1, v) for k, v in shapes.items()}
    m, v = ({k: np.zeros(x) for k, x in shapes.items()} for _ in range(2))
    share = min(max(y.mean(), 0.01), 0.99)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    order, step = np.arange(len(bags)), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for a in range(0, len(order), 64):
            own = order[a : a + 64]
            sizes = np.array([len(bags[k]) for k in own])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            g = gradients(p, np.concatenate([bags[k] for k in own]), np.repeat(np.arange(len(own)), sizes), starts, y[own], weight[own])
            step += 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {**p, "mean": mean, "sd": sd}


NAMES = ("V", "U", "w", "c", "b", "mean", "sd")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, most: int = SAMPLE) -> DataFrame:
    """One row: the numbers of the model, by name, flattened."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        p = learn([encode(t) for t in pdf["text"]], pdf["y"].to_numpy(float))
        forget()
        release_memory()
        return pd.DataFrame({k: [np.asarray(p[k], float).ravel()] for k in NAMES})

    out = fields(*((k, "array<double>") for k in NAMES))
    return labelled_sample(docs, labels, label, folds, held_out, most).groupBy(F.lit(1).alias("one")).applyInPandas(train, out)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id and score of every row."""
    rows = model.collect()
    p = {k: np.array(rows[0][k]) for k in NAMES} if rows else None
    if p:
        p["V"], p["U"] = p["V"].reshape(SIZE, ATTENTION), p["U"].reshape(SIZE, ATTENTION)
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                if p is None:
                    scores = np.full(batch.num_rows, PRIOR)
                else:
                    bags = [encode(t) for t in batch.column("text").to_pylist()]
                    sizes = np.array([len(b) for b in bags])
                    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    scores = forward(p, (np.concatenate(bags) - p["mean"]) / p["sd"], np.repeat(np.arange(len(bags)), sizes), starts)[0]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.asarray(scores, float))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(tidy(run, forget), fields(("doc_id", "long"), ("score", "double")))


def op6_mil_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
