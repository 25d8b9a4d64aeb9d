"""Components and nested selection for tables with more columns than rows.

A table of n rows and p features, p far above n, has at most n components, and they follow from the n x n matrix of
the rows' products. Features come in long form; blocks of them are scaled and multiplied in tasks and only n x n sums are sent
on, for every fold at once. Eigenvectors of the training rows' part give all rows' components; loadings follow by one
more pass over the blocks. Nothing of the size p reaches a task's memory whole, or the driver at all.

Cells: stride, pid, task, y, feature, value; a missing cell is 0 after scaling, the mean. Rows (pid, task) number ``MOST_ROWS``
at most, for which the sums of 25 fits fit a task; tables with more rows than that are for ``search.Search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import staged
from .search import LEAST_VARIANCE, REFIT, Search, Trial, parts_of, with_folds

MOST_ROWS = 1000
#: Features of a block, and tasks that sum blocks.
WIDTH, TASKS = 512, 32


@dataclass
class Rows:
    """The rows of a wide table in a fixed order, with their labels and folds."""

    table: pd.DataFrame
    outer: int
    inner: int

    def fits(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        return parts_of(self.table, self.outer, self.inner) if self.outer else iter([(0, REFIT, np.ones(len(self.table), bool), np.zeros(len(self.table), bool))])


def rows_of(cells: DataFrame, outer: int, inner: int, seed: int = 42) -> Rows:
    """The rows with their folds: a small table, refused beyond ``MOST_ROWS``."""
    found = cells.groupBy("pid", "task").agg(F.max("y").alias("y"))
    if found.count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: use Search, whose sums are of the size of the columns")
    placed = with_folds(found, outer, inner, seed) if outer else found
    return Rows(placed.toPandas().sort_values(["pid", "task"]).reset_index(drop=True), outer, inner)


def scaling(x: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Columns as z-scores of the rows to learn from; columns that hardly vary there, and missing cells, are 0."""
    own = x[learn]
    n = np.maximum((~np.isnan(own)).sum(0), 1)
    mean = np.nansum(own, 0) / n
    spread = np.nansum((own - mean) ** 2, 0) / n
    kept = spread > LEAST_VARIANCE
    return np.nan_to_num((x - mean) / np.sqrt(np.where(kept, spread, 1.0))) * kept


def blocks_of(cells: DataFrame, rows: Rows) -> DataFrame:
    """stride, block, feature, values: one row for each feature with its value in every row (null where it lacks one)."""
    place = {(p, t): k for k, (p, t) in enumerate(zip(rows.table["pid"], rows.table["task"], strict=True))}
    spark = cells.sparkSession
    known = F.broadcast(spark.createDataFrame([(p, t, k) for (p, t), k in place.items()], cells.select("pid", "task").schema.add("_row", T.IntegerType())))  # MOST_ROWS at most
    lists = cells.join(known, ["pid", "task"]).groupBy("stride", "feature").agg(F.map_from_entries(F.collect_list(F.struct("_row", F.col("value").cast("double").alias("v")))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(len(place) - 1)), lambda k: F.try_element_at("_m", k))
    n = max(1, -(-cells.select("feature").distinct().count() // WIDTH))
    return lists.select("stride", F.pmod(F.xxhash64("feature"), F.lit(n)).cast("int").alias("block"), "feature", values.alias("values"))


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Rows x features."""
    return np.stack([np.array(v, float) for v in pdf["values"]], 1)


def grams(vectors: DataFrame, rows: Rows) -> DataFrame:
    """stride, outer, inner, gram: of every fit the products of all rows, scaled by those that it learns from."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        stride = None

        def handed() -> pd.DataFrame:
            return pd.DataFrame({"stride": stride, "outer": [k for k, _ in held], "inner": [i for _, i in held], "part": [v.tobytes() for v in held.values()]})

        for part in parts:
            for own, block in part.groupby("stride", sort=False):
                if own != stride and held:
                    yield handed()
                    held.clear()
                stride = own
                for at in range(0, len(block), WIDTH):
                    x = matrix(block.iloc[at : at + WIDTH])
                    for k, i, learn, _ in rows.fits():
                        z = scaling(x, learn)
                        held[k, i] = held.get((k, i), 0) + z @ z.T
        if held:
            yield handed()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["part"])
        return pd.DataFrame({"stride": pdf["stride"].iloc[:1], "outer": pdf["outer"].iloc[:1], "inner": pdf["inner"].iloc[:1], "gram": [total.tobytes()]})

    dealt = vectors.repartition(TASKS, "stride", "block").sortWithinPartitions("stride")
    parts = dealt.mapInPandas(sums, "stride int, outer int, inner int, part binary")
    return parts.groupBy("stride", "outer", "inner").applyInPandas(added, "stride int, outer int, inner int, gram binary")


def decomposed(gram: np.ndarray, learn: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all rows that hold ``share`` of the learnt rows' variance, weights (learnt rows x components) that turn scaled features into
    loadings, and the variances. A component's largest score among the learnt rows is positive."""
    values, vectors = np.linalg.eigh(gram[np.ix_(learn, learn)])
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    shares = np.cumsum(values) / (values.sum() or 1.0)
    k = min(int(np.searchsorted(shares, share - 1e-12)) + 1, int((values > values[0] * 1e-10).sum()) or 1)
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    weights = vectors / np.sqrt(np.maximum(values, 1e-300))
    return gram[:, learn] @ weights, weights, values / learn.sum()


class Kernel:
    """A class-balanced least-squares classifier on components with a Gaussian kernel."""

    def __init__(self, components: np.ndarray, y: np.ndarray, penalty: float, gamma: float):
        self.x, self.gamma = components, gamma
        n = np.bincount(y, minlength=2)
        weight = np.where(n > 0, len(y) / (2 * np.maximum(n, 1)), 1.0)[y]
        system = np.ones((len(y) + 1, len(y) + 1))
        system[0, 0] = 0.0
        system[1:, 1:] = self.kernel(components) + np.diag(1 / (penalty * weight))
        found = np.linalg.solve(system, np.concatenate([[0.0], 2.0 * y - 1]))
        self.offset, self.alpha = found[0], found[1:]

    def kernel(self, other: np.ndarray) -> np.ndarray:
        far = (other**2).sum(1)[:, None] + (self.x**2).sum(1)[None] - 2 * other @ self.x.T
        return np.exp(-self.gamma * np.maximum(far, 0))

    def classes(self, components: np.ndarray) -> np.ndarray:
        return (self.kernel(components) @ self.alpha + self.offset > 0).astype(int)


def components(cells: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """stride, pid, task, components (array) of all rows, fitted on all of them; and stride, feature, component, loading."""
    rows = rows_of(cells, 0, 0)
    vectors = staged(blocks_of(cells, rows), "wide-blocks")
    gram = staged(grams(vectors, rows), "wide-grams")
    every, spark = np.ones(len(rows.table), bool), cells.sparkSession
    fits = {r["stride"]: decomposed(np.frombuffer(r["gram"]).reshape(len(every), -1), every, share) for r in gram.collect()}  # strides x n x n
    out = [(int(s), *map(lambda v: v.item() if hasattr(v, "item") else v, (p, t)), c.tolist()) for s, (scores, _, _) in fits.items() for p, t, c in zip(rows.table["pid"], rows.table["task"], scores, strict=True)]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    scores = spark.createDataFrame(out, f"stride int, pid {kinds['pid']}, task {kinds['task']}, components array<double>")
    return scores, loadings(vectors, {(s, 0): (every, w) for s, (_, w, _) in fits.items()}).drop("outer")


def loadings(vectors: DataFrame, weights: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """stride, outer, feature, component, loading by one pass over the blocks; ``weights`` by (stride, outer): learnt rows, weights."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for stride, block in part.groupby("stride", sort=False):
                for at in range(0, len(block), WIDTH):
                    own = block.iloc[at : at + WIDTH]
                    x = matrix(own)
                    for (s, k), (learn, w) in shared.value.items():
                        if s == stride:
                            found = scaling(x, learn)[learn].T @ w
                            f, c = np.indices(found.shape).reshape(2, -1)
                            yield pd.DataFrame({"stride": stride, "outer": k, "feature": own["feature"].to_numpy()[f], "component": c, "loading": found.ravel()})

    return vectors.mapInPandas(run, "stride int, outer int, feature string, component int, loading double")


class WideSearch(Search):
    """``search.Search`` for wide tables: the same tables of trials, choices and scores, from n x n products by stride. The trials' strides
    alone are read where ``cells`` is a table partitioned by stride."""

    def __init__(self, cells: DataFrame, tried: list[Trial], outer: int = 5, inner: int = 4, seed: int = 42):
        self.tried, self.outer, self.inner = tried, outer, inner
        spark = cells.sparkSession
        cells = cells.filter(F.col("stride").isin(sorted({t.stride for t in tried})))
        self.rows = rows = rows_of(cells, outer, inner, seed)
        self.vectors = staged(blocks_of(cells, rows), "wide-blocks")
        self.grams = staged(grams(self.vectors, rows), "wide-grams")
        table = [(k, t.stride, t.penalty, t.gamma, t.share) for k, t in enumerate(tried)]
        by_stride = spark.createDataFrame(table, "trial int, stride int, penalty double, gamma double, share double")
        by_stride = by_stride.groupBy("stride").agg(F.collect_list(F.struct("trial", "penalty", "gamma", "share")).alias("trials"))
        y, task = rows.table["y"].to_numpy(int), rows.table["task"].to_numpy()
        names = sorted(set(task.tolist()))

        def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
            k, i = int(pdf["outer"].iloc[0]), int(pdf["inner"].iloc[0])
            learn, held = next((a, b) for o, n, a, b in rows.fits() if (o, n) == (k, i))
            gram, out = np.frombuffer(pdf["gram"].iloc[0]).reshape(len(y), -1), []
            for trial in pdf["trials"].iloc[0]:
                scores = decomposed(gram, learn, trial["share"])[0]
                found = Kernel(scores[learn], y[learn], trial["penalty"], trial["gamma"]).classes(scores[held])
                for name in names:
                    mine = task[held] == name
                    out.append((k, i, trial["trial"], name, *map(int, np.bincount(2 * y[held][mine] + found[mine], minlength=4))))
            return pd.DataFrame(out, columns=["outer", "inner", "trial", "task", "tn", "fp", "fn", "tp"])

        joined = self.grams.join(by_stride, "stride")
        self.counts = staged(joined.groupBy("stride", "outer", "inner").applyInPandas(evaluate, "outer int, inner int, trial int, task string, tn long, fp long, fn long, tp long"), "wide-counts")

    def chosen_fits(self) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray, Kernel]]:
        """Of each outer fold: stride, learnt rows, weights, all rows' components, classifier of its chosen trial."""
        picked, y, out = self.chosen(), self.rows.table["y"].to_numpy(int), {}
        learnt = {k: a for k, i, a, _ in self.rows.fits() if i == REFIT}
        wanted = {(k, self.tried[t].stride) for k, t in picked.items()}
        found = self.grams.filter((F.col("inner") == REFIT) & reduce(or_, ((F.col("outer") == k) & (F.col("stride") == s) for k, s in wanted), F.lit(False))).collect()
        for r in found:  # one n x n matrix a fold
            k, trial = r["outer"], self.tried[picked[r["outer"]]]
            scores, weights, _ = decomposed(np.frombuffer(r["gram"]).reshape(len(y), -1), learnt[k], trial.share)
            out[k] = (trial.stride, learnt[k], weights, scores, Kernel(scores[learnt[k]], y[learnt[k]], trial.penalty, trial.gamma))
        return out

    def component_importance(self, rows: DataFrame | None = None, repeats: int = 25, seed: int = 42) -> DataFrame:
        """outer, component, importance: by how much the balanced accuracy on held-out rows falls when a component is dealt anew among
        them, on average over ``repeats``: one task for each fold and component."""
        fits, y, own = self.chosen_fits(), self.rows.table["y"].to_numpy(int), self.rows.table["outer"].to_numpy()
        spark = self.counts.sparkSession
        shared = spark.sparkContext.broadcast({k: (f[3][own == k], y[own == k], f[4]) for k, f in fits.items()})
        pairs = spark.createDataFrame([(k, c) for k, f in fits.items() for c in range(f[3].shape[1])], "outer int, component int")

        def balanced(found: np.ndarray, true: np.ndarray) -> float:
            return float(np.mean([(found[true == c] == c).mean() for c in np.unique(true)]))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            k, c = int(pdf["outer"].iloc[0]), int(pdf["component"].iloc[0])
            x, true, model = shared.value[k]
            rng, base, drops = np.random.default_rng([seed, k, c]), balanced(model.classes(x), true), []
            for _ in range(repeats):
                mixed = x.copy()
                mixed[:, c] = rng.permutation(mixed[:, c])
                drops.append(base - balanced(model.classes(mixed), true))
            return pd.DataFrame({"outer": [k], "component": [c], "importance": [float(np.mean(drops))]})

        return pairs.groupBy("outer", "component").applyInPandas(run, "outer int, component int, importance double")

    def loadings(self) -> DataFrame:
        """outer, feature, component, loading of each fold's chosen fit, by one pass over the blocks."""
        return loadings(self.vectors, {(f[0], k): (f[1], f[2]) for k, f in self.chosen_fits().items()}).drop("stride")
