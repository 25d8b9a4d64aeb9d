"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (lower case, stripped of marks), stems of longer words, pairs of neighbours and pairs with one word
between, each hashed to one of 2**BITS places; a place counts once a text. FTRL-proximal keeps a rate for
each coordinate and sets small weights to zero, so the fitted model is a few thousand (place, weight) pairs
that are broadcast.

The model is fitted in one task on a bounded sample: at most SAMPLE labelled rows, those whose hashed key is
smallest (a fixed choice, spread over the table). Scoring covers all rows and whole texts, without a shuffle.

Defined results: null and empty texts have no features and get the score of the bias; a label other than 0
or 1, or null, is not learnt from; without labelled rows all scores are the prior PRIOR; repeated rows are
scored one by one; labels of a doc_id that repeats are learnt from once a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, fold, release_memory, texts, tidy, workers_import_this

BITS = 22
#: Most labelled rows that the model is fitted on; their features fit one task.
SAMPLE = 6_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
PRIOR = 0.1
#: Leading letters of a longer word that count as its stem: compounds share them.
STEMS = (4, 5, 6, 7)
REMEMBERED = 600_000
#: Odd multipliers that mix the hashes of two words.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_/\\`~+=@^…«»„“”‚‘’–—"

_shared: dict = {}


def forget() -> None:
    """Drops what this Python worker has remembered."""
    _shared.clear()


class _Words(dict):
    """Row of a word in ``table``: hashes of its lower-case form without marks and of that form's first
    STEMS letters (0 where it is no longer than that); row 0 is for what has no letters."""

    def __init__(self):
        self.table = np.zeros((1 << 14, 1 + len(STEMS)), np.uint64)
        self.rows = 1

    def __missing__(self, word: str) -> int:
        bare = word.strip(MARKS).lower()
        if not bare:
            self[word] = 0
            return 0
        row = self[word] = self.rows
        self.rows += 1
        if row >= len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        hashed = [xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1]
        hashed += [xxhash.xxh3_64_intdigest(bare[:k].encode("utf-8", "surrogatepass"), seed=k) | 1 if len(bare) > k else 0 for k in STEMS]
        self.table[row] = hashed
        return row

    def forget(self) -> None:
        self.clear()
        self.rows = 1

    def rows_of(self, text: str) -> np.ndarray:
        split = text.split()
        found = np.fromiter(map(self.__getitem__, split), np.int64, len(split))
        return found[found != 0]


def word_hashes(text: str) -> np.ndarray:
    """A row of hashes for each word: the word, then its stems."""
    words = _shared.setdefault("words", _Words())
    if len(words) > REMEMBERED:
        words.forget()
    rows = words.rows_of(text)
    return words.table[rows]


def spots(h: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * factor >> np.uint64(64 - bits)).astype(np.int64)


def neighbours(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of pairs and skip pairs."""
    with np.errstate(over="ignore"):
        two, skip = h[:-1] * MIX[1] ^ h[1:], h[:-2] * MIX[2] ^ h[2:]
    return np.concatenate((spots(two, MIX[0], bits), spots(skip, MIX[1], bits)))


def own_places(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Places of words and stems; a missing stem repeats its word."""
    word, stems = spots(hashed[:, :1], MIX[0], bits), spots(hashed[:, 1:], MIX[2], bits)
    return np.concatenate((word, np.where(hashed[:, 1:] != 0, stems, word)), axis=1)


def places(hashed: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of all words, stems, pairs and skip pairs of a text, with repeats."""
    return np.concatenate((own_places(hashed, bits).ravel(), neighbours(hashed[:, 0], bits)))


class Scorer:
    """Scores texts by a fitted model. Whether a word or one of its stems has a weight is worked out once a
    word; only such words, and neighbours that have a weight, are looked at further."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS):
        at, w, self.bias = model
        self.bits, self.table, self.words, self.known = bits, np.zeros(1 << bits, np.float32), _Words(), 1
        self.table[at] = w
        self.weighs = self.table != 0
        self.flag = np.zeros(1, bool)

    def scores(self, batch: list[str]) -> np.ndarray:
        if len(self.words) > REMEMBERED:
            self.words.forget()
            self.known = 1
        rows = [self.words.rows_of(t) for t in batch]
        words = self.words
        if len(self.flag) < len(words.table):
            self.flag = np.concatenate((self.flag, np.zeros(len(words.table) - len(self.flag), bool)))
        self.flag[self.known : words.rows] = self.weighs[own_places(words.table[self.known : words.rows], self.bits)].any(axis=1)
        self.known = words.rows
        out = np.empty(len(batch))
        for k, r in enumerate(rows):
            near = neighbours(words.table[r, 0], self.bits)
            near = near[self.weighs[near]]
            own = np.unique(r[self.flag[r]])
            found = np.unique(np.concatenate((near, own_places(words.table[own], self.bits).ravel())))
            out[k] = self.bias + float(self.table[found].astype(float).sum())
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias). McMahan et al. 2013: w = 0 where |z| <= L1, else
    -(z - sign(z) L1) / ((BETA + sqrt(n)) / ALPHA + L2). The bias has no L1."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            x = rows[k]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            wb = -zb / ((BETA + math.sqrt(nb)) / ALPHA)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, wb + float(w.sum())))))
            g = p - labels[k]
            g2 = g * g
            z[x] = zx + g - (np.sqrt(nx + g2) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g2
            zb += g - (math.sqrt(nb + g2) - math.sqrt(nb)) / ALPHA * wb
            nb += g2
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return at, w[at], -zb / ((BETA + math.sqrt(nb)) / ALPHA)


def learnt(batch: Iterable[str], labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """``ftrl`` over texts. Their places are kept in 32 bits, and the words go before the model's arrays come."""
    rows = [np.unique(places(word_hashes(t), bits)).astype(np.int32) for t in batch]
    forget()
    release_memory()
    return ftrl(rows, labels, bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """At most ``most`` rows (text, y) to learn from, never of the held-out fold. Keys are chosen before any
    text moves: the light label rows are ranked by hash, and the texts of the chosen meet them."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (fold("_id", folds) != held_out))
        .orderBy(F.xxhash64("_id"), "_id", "y")
        .limit(most)
    )
    # Bounded by ``most`` rows of two numbers.
    return texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, most: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """One row: places array<int>, weights array<float>, bias."""
    out = fields(("places", "array<int>"), ("weights", "array<float>"), ("bias", "double"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        at, w, bias = learnt(pdf["text"], pdf["y"].to_numpy(float), bits)
        release_memory()
        return pd.DataFrame({"places": [at.astype(np.int32)], "weights": [w.astype(np.float32)], "bias": [float(bias)]})

    return labelled_sample(docs, labels, label, folds, held_out, most).groupBy(F.lit(1).alias("one")).applyInPandas(train, out)


def fitted(model: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The model as arrays: one row of at most 2**BITS pairs, in practice hundreds. The prior if there is none."""
    rows = model.collect()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), math.log(PRIOR / (1 - PRIOR))
    return np.array(rows[0][0], np.int64), np.array(rows[0][1], np.float32), rows[0][2]


def score(docs: DataFrame, model: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id and score of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bits)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(tidy(run, forget), fields(("doc_id", "long"), ("score", "double")))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, same columns, with a score under the threshold; scored in place, no text is shuffled. A
    task holds one Arrow batch and the strings of 512 texts."""
    workers_import_this(docs.sparkSession)
    shared, at_text = docs.sparkSession.sparkContext.broadcast(fitted(fit(docs, labels))), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [t or "" for t in batch.column(at_text).cast(pa.string()).to_pylist()]
                yield batch.filter(pa.array(scorer.scores(found) < threshold))

    return docs.mapInArrow(tidy(run, forget), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
